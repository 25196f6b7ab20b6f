"""Filters of views and parameters, as predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Predicates by operator.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)), "contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v),
}


@dataclass(frozen=True)
class Filter:
    """A predicate on a field: an operator and its value; a range has both ends, null for an open one."""

    field: str
    operator: str = "in"
    value: Any = None

    def predicate(self) -> Column:
        c = F.col(self.field)
        if self.operator == "range":
            low, high = self.value
            ends = [p for p in (None if low is None else c >= low, None if high is None else c <= high) if p is not None]
            return reduce(lambda a, b: a & b, ends, F.lit(True))
        return OPERATORS[self.operator](c, self.value)


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    for f in filters:
        df = df.where(f.predicate())
    return df


#: Why a filter is left out.
NO_FIELD, NO_OPERATOR, NO_VALUE, NO_PREDICATE = "no such column", "no such operator", "the value doesn't fit the column", "not a predicate"


def checked(df: DataFrame, filters: list[Filter]) -> tuple[list[Filter], DataFrame]:
    """(filters that df can run, the others as rows of place, field, operator and reason).

    Each filter is looked at alone, against the schema, and no row of df is read: the column must be there, the operator known, the
    value (each of a list, each end of a range) one that the column's type can take, and the whole a predicate. A null value
    fits no column. All values are cast in one row.
    """
    spark, types = df.sparkSession, {f.name: f.dataType for f in df.schema}
    text = {"contains", "startswith", "endswith"}
    reasons: dict[int, str] = {}
    casts: list[Column] = []
    for i, f in enumerate(filters):
        if f.field not in types:
            reasons[i] = NO_FIELD
        elif f.operator not in OPERATORS and f.operator != "range":
            reasons[i] = NO_OPERATOR
        elif f.operator == "range" and not (isinstance(f.value, (tuple, list)) and len(f.value) == 2):
            reasons[i] = NO_VALUE
        elif f.operator in text and not (isinstance(f.value, str) and types[f.field].typeName() == "string"):
            reasons[i] = NO_VALUE
        else:
            values = list(f.value) if isinstance(f.value, (list, tuple, set)) and f.operator in ("in", "not in", "range") else [f.value]
            try:
                fits = [F.lit(v).try_cast(types[f.field]).isNotNull() for v in values if not (v is None and f.operator == "range")]
                df.where(f.predicate())
                casts.append(reduce(lambda a, b: a & b, fits, F.lit(True)).alias(str(i)))
            except (PySparkException, TypeError, ValueError):
                reasons[i] = NO_PREDICATE
    if casts:
        reasons |= {int(i): NO_VALUE for i, ok in spark.range(1).select(*casts).first().asDict().items() if not ok}
    bad = [(i, filters[i].field, filters[i].operator, reason) for i, reason in sorted(reasons.items())]
    return [f for i, f in enumerate(filters) if i not in reasons], spark.createDataFrame(bad, "place long, field string, operator string, reason string")


def equal_to(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Equality by column; columns that df lacks are left out."""
    return apply_filters(df, [Filter(c, "=", v) for c, v in values.items() if c in df.columns])


def all_of(df: DataFrame, predicates: list[str]) -> DataFrame:
    """SQL predicates that must all hold."""
    return df.where(" AND ".join(f"({p})" for p in predicates)) if predicates else df


def last_days(df: DataFrame, ts: str, days: int, anchor: Column | None = None) -> DataFrame:
    """Rows within so many days before the anchor, by default the latest row."""
    if anchor is None:
        anchor = F.lit(df.agg(F.max(ts)).first()[0])  # one value, so that the filter reaches the scan
    return df.where(F.col(ts) > anchor - F.make_dt_interval(F.lit(days)))


def top_n(df: DataFrame, dim: str, measure: Column, n: int) -> DataFrame:
    """Rows of the n values of dim with the largest measure, null measures last, ties by dim. Null is no value of dim. Only n rows are sent round."""
    best = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("_dim")).agg(measure.alias("_measure")).orderBy(F.desc_nulls_last("_measure"), "_dim").limit(n)
    return df.join(F.broadcast(best), df[dim] == best["_dim"], "left_semi")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def by_list(c: Column, values: list[str]) -> Column:
    """The place of a value in a manual order; values that aren't listed come last."""
    at = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(at > 0, at).otherwise(len(values) + 1)


def group_of(c: Column, groups: dict[str, list[str]], other: str) -> Column:
    """The named group of a value."""
    return F.coalesce(*[F.when(c.isin(members), name) for name, members in groups.items()], F.lit(other))


def what_if(spark: SparkSession, low: float = 0, high: float = 100, step: float = 1, default: float | None = None) -> DataFrame:
    """(value, is_default): the series of a numeric parameter."""
    n = int((high - low) / step + 1e-9) + 1
    return spark.range(n).select((F.col("id") * step + low).cast("double").alias("value")).withColumn("is_default", F.col("value") == float(low if default is None else default))


def what_if_of_list(values: list[float], current: float | None = None) -> dict:
    """Range of a parameter given as a list: its ends, the step between the two smallest, the current value."""
    v = sorted(values)
    return {"low": v[0], "high": v[-1], "step": v[1] - v[0] if len(v) > 1 else 1, "default": v[0] if current is None else current} if v else {"low": 0, "high": 100, "step": 1, "default": 0}


def selected_value(c: Column, default: Any) -> Column:
    """The one value chosen, else the default."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(default))


# Kinds of filters by a workbook's classes.
FILTER_KINDS = {"categorical": "BASIC", "quantitative": "ADVANCED", "relative-date": "RELATIVE_DATE", "top": "TOP_N"}


def filter_kind(class_: Column) -> Column:
    """BASIC, ADVANCED, RELATIVE_DATE or TOP_N of a workbook's filter class; BASIC for others."""
    return F.coalesce(*[F.when(F.lower(class_) == c, k) for c, k in FILTER_KINDS.items()], F.lit("BASIC"))


def numeric_parameter(datatype: Column, domain: Column, members: Column) -> Column:
    """Whether a parameter is a numeric series: of a number's type, by range, or by a list of numbers only."""
    number = F.lower(datatype).isin("integer", "real", "float", "double")
    return number & ((domain == "range") | F.forall(members, lambda m: m.try_cast("double").isNotNull()))
