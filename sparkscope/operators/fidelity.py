"""Whether two formulations of a measure agree, slice by slice, and how they differ."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tablecalc import row_numbers

EPSILON = 1e-4


def measured(df: DataFrame, dims: list[str], measure: Column, name: str = "truth_value", predicates: Column | None = None, limit: int | None = None) -> DataFrame:
    """A measure by dims, ordered; the one total without dims."""
    df = df if predicates is None else df.where(predicates)
    out = (df.groupBy(*dims) if dims else df.groupBy()).agg(measure.cast("double").alias(name))
    return out.orderBy(*dims).limit(limit) if limit else out


def measured_text(df: DataFrame, dims: list[str], text: str, name: str = "truth_value") -> DataFrame:
    """A measure given as SQL text by dims; no rows where the text still names a calculation by its id."""
    if re.search(r"Calculation_\d+", text):
        return measured(df, dims, F.count("*"), name).limit(0)
    return measured(df, dims, F.expr(text), name)


def in_context(df: DataFrame, dims: list[str], kept: list[str], measure: Column, name: str = "candidate_value") -> DataFrame:
    """A measure that ignores all filters but those on the kept dimensions, for each slice of dims: it is the same for slices that agree on them. Nulls are slices and agree with each other."""
    slices = df.select(*dims).distinct()
    if not kept:
        return slices.join(F.broadcast(df.agg(measure.cast("double").alias(name))))  # one row
    total = df.groupBy(*kept).agg(measure.cast("double").alias(name)).select(*[F.col(k).alias(f"_k_{k}") for k in kept], name)
    return slices.join(total, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in kept])).select(*dims, name)


def compare(truth: DataFrame, candidate: DataFrame, dims: list[str], epsilon: float = EPSILON, keep_extra: bool = False) -> DataFrame:
    """Each slice of truth with truth_value, candidate_value, delta, relative_error, passed and error_category.

    Slices meet by their dims, nulls included, totals by being the only row. Null counts as zero. With keep_extra slices that only the candidate has come too, as EXTRA_VALUE.
    """
    t, c = truth.select(*dims, "truth_value", F.lit(True).alias("_t")), candidate.select(*[F.col(d).alias(f"_c_{d}") for d in dims], "candidate_value", F.lit(True).alias("_c"))
    on = reduce(lambda a, b: a & b, [t[d].eqNullSafe(c[f"_c_{d}"]) for d in dims], F.lit(True))
    both = t.join(c, on, "full" if keep_extra else "left") if dims else t.join(F.broadcast(c), F.lit(True), "left")
    x, y = F.coalesce("truth_value", F.lit(0.0)), F.coalesce("candidate_value", F.lit(0.0))
    delta = F.abs(x - y)
    relative = F.when(F.abs(x) < 1e-8, F.when(delta < 1e-8, 0.0).otherwise(1.0)).otherwise(delta / F.abs(x))
    found = F.col("_c").isNotNull() & F.col("_t").isNotNull()
    passed = found & F.when(F.abs(x) < 1e-8, delta <= epsilon).otherwise(relative <= epsilon)
    names = [F.coalesce(F.col(d), F.col(f"_c_{d}")).alias(d) if keep_extra else F.col(d) for d in dims]
    kind = F.when(F.col("_t").isNull(), "EXTRA_VALUE").when(F.col("_c").isNull(), "MISSING_VALUE").when(passed, "PERFECT_MATCH").otherwise(category(x, y, relative))
    return both.select(*names, "truth_value", "candidate_value", delta.alias("delta"), relative.alias("relative_error"), passed.alias("passed"), kind.alias("error_category"))


def category(truth: Column, candidate: Column, relative: Column) -> Column:
    """The kind of a slice's error: zero on one side, a factor of 100 or 10, then by size."""
    ratio = F.abs(F.try_divide(candidate, truth))
    near = lambda f: (ratio - f) / f
    at = lambda f: F.abs(near(f)) < 0.01
    zero = (F.abs(truth) < 1e-8) != (F.abs(candidate) < 1e-8)
    return (
        F.when(zero, "NULL_HANDLING").when(relative < 1e-4, "ROUNDING_ERROR").when(at(100.0) | at(0.01), "SCALE_ERROR").when(at(10.0) | at(0.1), "SCALE_ERROR")
        .when(relative > 0.1, "CONTEXT_SHIFT").when(relative > 0.05, "GRAIN_MISMATCH").otherwise("AGGREGATION_MISMATCH")
    )


def verdict(slices: DataFrame) -> DataFrame:
    """One row: slices, passed ones, pass_rate, overall (false without slices), largest and mean delta."""
    ok = F.count_if("passed")
    return slices.agg(
        F.count("*").alias("slices"), ok.alias("passed_slices"), F.round(F.coalesce(F.try_divide(ok * 1.0, F.count("*")), F.lit(0.0)), 6).alias("pass_rate"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("overall_passed"),
        F.round(F.avg("delta"), 4).alias("avg_delta"), F.round(F.max("delta"), 4).alias("max_delta"),
    )


def error_breakdown(slices: DataFrame) -> DataFrame:
    return slices.where(~F.col("passed")).groupBy("error_category").agg(F.count("*").alias("n"))


def failure_analysis(slices: DataFrame) -> DataFrame:
    """One row: the most frequent category of failed slices, whether all have it, and the confidence in it."""
    by = error_breakdown(slices)
    total = by.agg(F.sum("n").alias("failed"), F.max_by("error_category", F.struct("n", "error_category")).alias("category"), F.max("n").alias("most"))
    part = F.col("most") / F.col("failed")
    return total.select("category", "failed", (F.col("most") == F.col("failed")).alias("all_alike"), F.when(part == 1, 0.9).when(part > 0.5, 0.7).otherwise(0.5).alias("confidence"))


def confidence_buckets(conversions: DataFrame, score: str = "confidence") -> DataFrame:
    """One row: conversions that are automatic (0.9 and over), manual (0.7 and over), complex, and the automatic rate."""
    s = F.col(score)
    auto = F.count_if(s >= 0.9)
    return conversions.agg(auto.alias("automatic"), F.count_if((s >= 0.7) & (s < 0.9)).alias("manual"), F.count_if(s < 0.7).alias("complex"), F.round(F.coalesce(F.try_divide(auto * 1.0, F.count("*")), F.lit(0.0)), 6).alias("rate"))


def latest(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The last row of each key by time; one state wins by max_by, so a key's history isn't sorted."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), ts).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def results_by(conversions: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """Every conversion with its slices' number and whether all passed; false without any."""
    made = slices.groupBy(key).agg(F.count("*").alias("n"), F.bool_and("passed").alias("ok"))
    return conversions.join(made, key, "left").select(conversions.columns[0] if key not in conversions.columns else key, F.coalesce("n", F.lit(0)).alias("slices"), F.coalesce("ok", F.lit(False)).alias("validated"))


def expired(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows older than so many days."""
    return rows.where(F.col(ts) < now - F.make_dt_interval(F.lit(days)))


def history(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows with their number within a key by time, ties in some order. Rows are numbered along a range sort and a key's first number is taken off, so a busy key is no task's alone."""
    numbered = row_numbers(rows, [key, ts], "_number")
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_number").alias("_first"))
    return numbered.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, (F.col("_number") - F.col("_first") + 1).alias("attempt"))
