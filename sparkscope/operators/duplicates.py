"""Duplicate columns of a table: by name, by suffix, by content, by likeness of names."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalized, words
from .profile import as_text, frequencies, generic_type, scalar_columns

SAME_CONTENT, SIMILAR_NAMES, RELATIVE = 0.95, 0.85, 1e-3


def pair_measures(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column1, column2, identical, similarity) of pairs of columns.

    Identical are columns of one type with equal rows, nulls in the same places. Numbers are as similar as the share of rows
    within a thousandth, all pairs in one scan; other pairs by the share of distinct values in common, all in one shuffle.
    """
    numeric = lambda c: generic_type(df.schema[c].dataType) == "NUMERIC"

    def one(a: str, b: str):
        x, y, both = F.col(f"`{a}`"), F.col(f"`{b}`"), F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        same_type = df.schema[a].dataType == df.schema[b].dataType
        alike = F.lit(None).cast("double")
        if numeric(a) and numeric(b):
            p, q = x.cast("double"), y.cast("double")
            near = F.abs(p - q) < RELATIVE * F.greatest(F.abs(p), F.abs(q), F.lit(1.0))
            alike = F.coalesce(F.avg(F.when(both, near.cast("int"))), F.lit(0.0))
        equal = F.count_if(~x.eqNullSafe(y)) == 0 if same_type else F.lit(False)
        return F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), equal.alias("identical"), alike.alias("rows_alike"))

    wide = df.agg(*[one(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    made = wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    others = sorted({c for a, b in pairs if not (numeric(a) and numeric(b)) for c in (a, b)})
    if not others:
        return made.select("column1", "column2", "identical", F.round("rows_alike", 6).alias("similarity"))
    shared = made.join(F.broadcast(jaccards(df, others)), ["column1", "column2"], "left")
    return shared.select("column1", "column2", "identical", F.round(F.coalesce("rows_alike", "jaccard", F.lit(0.0)), 6).alias("similarity"))


def jaccards(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column1, column2, jaccard) of all ordered pairs of columns that share a value: distinct values in common among all of both."""
    at = frequencies(df, columns).where("value is not null").groupBy("value").agg(F.collect_set("column").alias("at"))
    both = at.select("at", F.explode("at").alias("column1")).select("column1", F.explode("at").alias("column2")).groupBy("column1", "column2").agg(F.count("*").alias("n"))
    size = both.where("column1 = column2")
    sides = [F.broadcast(size.select(F.col("column1").alias(f"column{k}"), F.col("n").alias(f"n{k}"))) for k in "12"]
    pairs = both.where("column1 <> column2").join(sides[0], "column1").join(sides[1], "column2")
    return pairs.select("column1", "column2", (F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))).alias("jaccard"))


def jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of distinct values that two columns have in common."""
    at = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), as_text(df, c).alias("value")) for k, c in ((1, a), (2, b))]))).where("value is not null").groupBy("value").agg(F.bit_or(F.col("k")).alias("k"))
    return at.agg(F.round(F.coalesce(F.avg((F.col("k") == 3).cast("int")), F.lit(0.0)), 6).alias("jaccard"))


def suffix_base(column: str) -> str | None:
    """The name before a suffix of copies: _2, _copy, (1)."""
    m = re.match(r"(.+?)(?:_\d+|_copy| ?\(\d+\))$", column, re.I)
    return m[1] if m else None


def names_alike(a: str, b: str) -> bool:
    """Equal or contained normal forms, close spelling, or half of the words shared."""
    x, y, v, w = normalized(a), normalized(b), {*words(a)}, {*words(b)}
    return x in y or y in x or SequenceMatcher(None, x, y).ratio() >= SIMILAR_NAMES or bool(v & w) and len(v & w) >= len(v | w) / 2


def duplicate_columns(df: DataFrame, validator: Callable[[str, str], bool] | None = None) -> list[dict]:
    """Groups of columns {rule, columns, identical, similarity}; a column is in one group at most. Rules in order: normal form, suffix, content with similar names, spelling."""
    cols, left, groups = scalar_columns(df), scalar_columns(df), []
    if len(cols) < 2:
        return []
    measured = {(r["column1"], r["column2"]): r for r in pair_measures(df, [*combinations(cols, 2)]).collect()}  # a row a pair of columns
    of = lambda a, b: measured.get((a, b)) or measured[(b, a)]

    def take(rule: str, found: list[str]) -> None:
        first, *rest = found
        groups.append({"rule": rule, "columns": found, "identical": [True, *[of(first, c)["identical"] for c in rest]], "similarity": [1.0, *[of(first, c)["similarity"] for c in rest]]})
        for c in found:
            left.remove(c)

    for rule, key in (("exact_name", normalized), ("suffix", lambda c: normalized(suffix_base(c) or c))):
        by = defaultdict(list)
        for c in left:
            by[key(c)].append(c)
        for found in by.values():
            if len(found) > 1:
                take(rule, found)
    for rule, alike in (
        ("content", lambda a, b: of(a, b)["similarity"] >= SAME_CONTENT and names_alike(a, b)), ("validated", lambda a, b: validator is not None and of(a, b)["similarity"] >= 0.8 and validator(a, b)),
        ("spelling", lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio() >= SIMILAR_NAMES),
    ):
        for seed in list(left):
            if seed in left and len(found := [seed, *[c for c in left if c != seed and alike(seed, c)]]) > 1:
                take(rule, found)
    return groups


def ambiguous_pairs(df: DataFrame, most: int = 10) -> list[dict]:
    """The pairs of columns most alike in spelling, between 0.6 and 0.9, best first: candidates for a person or a validator. Metadata: a pair of names each."""
    ratio = lambda a, b: SequenceMatcher(None, normalized(a), normalized(b)).ratio()
    found = [(ratio(a, b), a, b) for a, b in combinations(scalar_columns(df), 2)]
    best = sorted(((r, a, b) for r, a, b in found if 0.6 <= r <= 0.9), key=lambda x: (-x[0], x[1], x[2]))[:most]
    return [{"column1": a, "column2": b, "ratio": round(r, 6)} for r, a, b in best]


def recommendation(group: dict) -> str:
    keep, *rest = group["columns"]
    if all(group["identical"]):
        return f"keep {keep}, delete {', '.join(rest)}: the values are the same"
    return f"review {', '.join(group['columns'])}: the values differ in places" if min(group["similarity"]) >= SAME_CONTENT else f"review {', '.join(group['columns'])}: only the names are alike"
