"""Functions of calculated fields as Spark columns. They compose like any others, so a field is written as a Python expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zn(x: Column) -> Column:
    """x, or zero for null."""
    return F.coalesce(x, F.lit(0))


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def iif(condition: Column, then: Column, other: Column | None = None) -> Column:
    """A null condition counts as false; without other the result is then null."""
    chosen = F.when(condition, then)
    return chosen if other is None else chosen.otherwise(other)


def bands(*cases: tuple[Column, object], other: object = None) -> Column:
    """The value of the first case whose condition holds."""
    (first, value), *rest = cases
    out = F.when(first, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(F.lit(other))


def same_text(a: Column, value: str) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == value.lower()


def contains(a: Column, part: str) -> Column:
    """part stands in a; its case counts and it holds no wildcards."""
    return F.contains(a, F.lit(part))


def datepart(part: str, d: Column) -> Column:
    return F.date_part(F.lit(part), d).cast("long")


def datediff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of the part between a and b: year, quarter, month, week (from Monday), day, hour, minute or second."""
    if part == "day":
        return F.datediff(b, a).cast("long")
    if part in ("week", "hour", "minute", "second"):
        seconds = {"week": 7 * 86400, "hour": 3600, "minute": 60, "second": 1}[part]
        # The first second of the epoch was a Thursday, so weeks are counted from the Monday before.
        at = lambda d: F.floor((F.unix_seconds(d.cast("timestamp")) + (3 * 86400 if part == "week" else 0)) / seconds)
        return (at(b) - at(a)).cast("long")
    months = {"month": lambda d: F.year(d) * 12 + F.month(d), "quarter": lambda d: F.year(d) * 4 + F.quarter(d), "year": F.year}
    if part not in months:
        raise ValueError(f"no such part of a date: {part}")
    return (months[part](b) - months[part](a)).cast("long")


def divide(a: Column, b: Column, other: object = None) -> Column:
    """a / b, or other where b is zero or either is null."""
    ratio = F.try_divide(a, b)
    return ratio if other is None else F.coalesce(ratio, F.lit(other))


def calculate(aggregate, x: Column, condition: Column) -> Column:
    """An aggregate over the rows that meet a condition."""
    return aggregate(F.when(condition, x))


def attribute(x: Column) -> Column:
    """The value a group has in common, else null."""
    return F.when(F.min(x) == F.max(x), F.min(x))


def bin_of(x: Column, size: float) -> Column:
    """The lower end of x's bin; truncated to zero, as INT does."""
    return (x / size).cast("long") * size


#: Derivations of fields on a shelf: date parts as columns of a date, aggregates as columns of a measure.
DATE_PARTS = {"yr": F.year, "qr": F.quarter, "mn": F.month, "dy": F.dayofmonth, "wk": F.weekofyear}
AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "cnt": F.count, "cntd": F.countDistinct, "min": F.min, "max": F.max, "med": F.median, "attr": attribute, "var": F.var_samp, "varp": F.var_pop,
    "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "collect": F.collect_set, "none": lambda x: x,
}
