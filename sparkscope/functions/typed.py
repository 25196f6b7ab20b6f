"""One exact text for a value of any scalar type, so that equal values of unlike types meet and unlike values never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole doubles below this are exact as longs; those below WIDEST fit a decimal(38,0).
LONGS, WIDEST = float(1 << 63), 1e38


def exact_text(v: Column, t: T.DataType) -> Column:
    """The value's text. Whole numbers are written out without a point, whatever their type: 1, 1.0 and 1.00 meet, and bigints and decimals keep all their digits.

    Whole doubles below 2**63 stand for the integer that they are, larger ones for their shortest decimal form. Other decimals
    have the text of a double if that double's shortest form is the same number, else their own digits without trailing
    zeros. Zero has no sign; NaN and infinities are texts of their own; nulls stay null.
    """
    if isinstance(t, T.DecimalType):
        plain = F.regexp_replace(v.cast("string"), "0+$", "")
        d = v.cast("double")
        return F.when(v == F.floor(v), F.floor(v).cast("string")).when(d.try_cast(t) == v, d.cast("string")).otherwise(plain) if t.scale else v.cast("string")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        d = v.cast("double")
        whole = (d == F.floor(d)) & ~F.isnan(d)
        return F.when(whole & (F.abs(d) < LONGS), F.floor(d).cast("string")).when((F.abs(d) < WIDEST) & (F.abs(d) >= LONGS), d.try_cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    return v.cast("string")


def as_text(df: DataFrame, c: str) -> Column:
    """exact_text of a column."""
    return exact_text(F.col(f"`{c}`"), df.schema[c].dataType)


def whole_number(v: Column, t: T.DataType) -> Column:
    """The value as decimal(38,0) if it is a whole number that fits, else null."""
    if isinstance(t, T.IntegralType):
        return v.cast("decimal(38,0)")
    if isinstance(t, T.DecimalType):
        return F.when(v == F.floor(v), F.floor(v)).try_cast("decimal(38,0)")
    d = v.cast("double")
    return F.when(F.abs(d) < LONGS, F.when(d == F.floor(d), F.floor(d))).cast("decimal(38,0)")


def as_number(text: Column) -> Column:
    """A text's try_cast to double. A text that can't be a number, for want of a digit or by a letter that no number has, is not tried: a failed cast costs many times a match."""
    able = text.rlike("(?i)[0-9]|inf|nan") & ~text.rlike("(?i)[ghjklmoqrsuvwz]")
    return F.when(able, text.try_cast("double"))
