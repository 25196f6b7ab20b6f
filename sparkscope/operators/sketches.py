"""What one scan tells of columns before any value is shuffled: counts, types, ends, and mergeable sketches of distinct values.

A theta sketch keeps the smallest hashes of a column's distinct values. Columns with fewer values than it keeps are known
exactly; of others, how many hashes two sketches share bounds how many values the columns can share.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import as_number, exact_text
from .profile import generic_type

#: log2 of the hashes that a sketch keeps (32 kB).
KEPT_BITS = 12
#: Standard deviations by which an estimate may be wrong before a pair is dropped: once in 10**23 pairs.
DEVIATIONS = 10
#: Groups of scan tasks whose sketches meet first.
GROUPS = 64


def column_facts(tables: dict[str, DataFrame], columns: dict[str, list[str]], forms: Callable[[Column, T.DataType], list[Column]] | None = None, formed: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """(table, column, kind, rows, non_null, whole, numbers, dates, negative, low, high, sketch, forms): a row a column.

    low and high are the least and the greatest text, sketch that of the texts. For the columns in formed, forms gives further
    texts of a value, and the array forms their sketches. Sketches of scan tasks meet in GROUPS first and then by column.
    """
    parts, none = [], F.lit(None)
    for t, df in tables.items():
        given, facts = [], []  # a value's text and number are made once a row, before the aggregates that read them
        for i, c in enumerate(columns.get(t, ())):
            v, kind, form_of = F.col(f"`{c}`"), generic_type(df.schema[c].dataType), df.schema[c].dataType
            made = exact_text(v, form_of)
            sketch = lambda x: F.theta_sketch_agg(x, KEPT_BITS)
            plain = isinstance(form_of, (T.IntegralType, T.DoubleType, T.FloatType))
            value = v.cast("double") if plain else as_number(made) if kind in ("NUMERIC", "STRING") else none.cast("double")
            iso = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & v.try_cast("timestamp").isNotNull() if kind == "STRING" else F.lit(False)
            more = forms(made, form_of) if (t, c) in formed else []
            # A form that is the text itself has the text's sketch.
            names = [f"t{i}" if x is made else f"m{i}_{j}" for j, x in enumerate(more)]
            given += [made.alias(f"t{i}"), value.alias(f"d{i}"), iso.alias(f"s{i}"), *[x.alias(k) for k, x in zip(names, more) if k != f"t{i}"]]
            text, number, date = F.col(f"t{i}"), F.col(f"d{i}"), F.col(f"s{i}")
            facts.append(F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count(text).alias("non_null"), F.bool_and(text.isNull() | F.coalesce(number == F.floor(number), F.lit(False))).alias("whole"),
                F.count(number).alias("numbers"), (F.bool_and(text.isNull() | date) if kind == "STRING" else F.bool_and(F.lit(False))).alias("dates"), F.bool_or(number < 0).alias("negative"), F.min(text).alias("low"), F.max(text).alias("high"),
                sketch(text).alias("sketch"), (F.array(*[sketch(F.col(k)) for k in names]) if more else F.array().cast("array<binary>")).alias("forms"),
            ))
        if facts:
            wide = df.select(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("of_group"), *given).groupBy("of_group").agg(*[f.alias(f"f{i}") for i, f in enumerate(facts)])
            parts.append(wide.select(F.lit(t).alias("table"), F.inline(F.array(*[F.col(f"f{i}") for i in range(len(facts))]))))
    merged = {"rows": F.sum, "non_null": F.sum, "whole": F.bool_and, "numbers": F.sum, "dates": F.bool_and, "negative": F.bool_or, "low": F.min, "high": F.max}
    union = lambda x: F.theta_union_agg(x, KEPT_BITS)
    n = len(forms(F.lit(""), T.StringType())) if forms else 0
    whole = reduce(DataFrame.unionByName, parts).groupBy("table", "column", "kind").agg(*[f(k).alias(k) for k, f in merged.items()], union("sketch").alias("sketch"), *[union(F.get("forms", F.lit(i))).alias(f"form{i}") for i in range(n)])
    kept = [c for c in whole.columns if not c.startswith("form")]
    return whole.select(*kept, F.array(*[F.col(f"form{i}") for i in range(n)]).cast("array<binary>").alias("forms"))


def estimated(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs, of table1, column1, table2, column2, with form, n1, n2 and shared: estimates of distinct values of each side and of both, for the texts (form 0) and each further form."""
    all_of = F.concat(F.array("sketch"), "forms").alias
    side = lambda k: facts.select(F.col("table").alias(f"table{k}"), F.col("column").alias(f"column{k}"), all_of(f"s{k}"))
    # A row a column, a row a pair: metadata.
    met = pairs.join(F.broadcast(side(1)), ["table1", "column1"]).join(F.broadcast(side(2)), ["table2", "column2"])
    each = F.posexplode(F.arrays_zip("s1", "s2")).alias("form", "s")
    return met.select(*pairs.columns, each).select(*pairs.columns, "form", F.theta_sketch_estimate("s.s1").alias("n1"), F.theta_sketch_estimate("s.s2").alias("n2"), F.theta_sketch_estimate(F.theta_intersection("s.s1", "s.s2")).alias("shared"))


def can_reach(percent: float, n1: int, n2: int, shared: int) -> bool:
    """Whether columns with these estimates can share `percent` of the smaller one's values. Exact for columns that fit into their sketches, else wrong by DEVIATIONS at least."""
    kept, least = 1 << KEPT_BITS, min(n1, n2) * (percent - 1e-4) / 100  # percents are rounded to four digits
    if max(n1, n2) < kept:
        return shared >= least and shared > 0
    # The part of all hashes that both sketches see, and the least that the columns can have by their estimates.
    seen, least = kept / (max(n1, n2) * (1 + DEVIATIONS / math.sqrt(kept))), least / (1 + DEVIATIONS / math.sqrt(kept))
    return shared > least - DEVIATIONS * math.sqrt(least * (1 - seen) / seen)
