"""The graph of calculations: dependencies, levels, kinds."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import references

TABLE_CALCS = r"(?i)\b(RUNNING_\w+|WINDOW_\w+|RANK\w*|LOOKUP|INDEX|FIRST|LAST|SIZE|TOTAL|PREVIOUS_VALUE)\s*\("
AGGREGATES = r"(?i)\b(SUM|AVG|COUNT|COUNTD|MIN|MAX|MEDIAN|ATTR|STDEVP?|VARP?)\s*\("
LOD = r"(?i)\{\s*(FIXED|INCLUDE|EXCLUDE)\b"


def calc_kind(formula: Column) -> Column:
    """TABLE_CALCULATION, LOD_EXPRESSION, MEASURE or COLUMN, by what stands outermost first."""
    return F.when(formula.rlike(TABLE_CALCS), "TABLE_CALCULATION").when(formula.rlike(LOD), "LOD_EXPRESSION").when(formula.rlike(AGGREGATES), "MEASURE").otherwise("COLUMN")


def granularity(formula: Column) -> Column:
    return F.when(formula.rlike(TABLE_CALCS), "TABLE").when(formula.rlike(LOD) | formula.rlike(AGGREGATES), "AGGREGATE").otherwise("ROW")


def lod_kind(formula: Column) -> Column:
    """FIXED, INCLUDE or EXCLUDE, null without one."""
    found = F.upper(F.regexp_extract(formula, LOD, 1))
    return F.when(found != "", found)


def edges(calcs: DataFrame) -> DataFrame:
    """(source, target) for each name that a calculation (name, formula) refers to."""
    return calcs.select(F.explode(references(F.col("formula"))).alias("source"), F.col("name").alias("target")).select(F.trim(F.regexp_replace("source", r"\s*\([^()]*\)\s*$", "")).alias("source"), "target").distinct()


def levels(calcs: DataFrame) -> DataFrame:
    """(name, level): 0 for a base field, else one over the highest of what it refers to; calculations on or behind a cycle have null.

    The edges are metadata, a row a reference, and are read once.
    """
    names, of = {r["name"] for r in calcs.select("name").collect()}, defaultdict(set)
    for r in edges(calcs).collect():
        of[r["target"]].add(r["source"])
    level = {n: 0 for n in set().union(*of.values()) - names} if of else {}
    waiting, behind = {n: len(of[n]) for n in names}, defaultdict(set)
    for n in names:
        for source in of[n]:
            behind[source].add(n)
    ready = [*level, *(n for n in names if not of[n])]
    while ready:
        n = ready.pop()
        level.setdefault(n, 1 + max((level[s] for s in of[n]), default=0))
        for target in behind[n]:
            waiting[target] -= 1
            if not waiting[target]:
                ready.append(target)
    rows = [(n, level.get(n)) for n in sorted(names | level.keys())]
    return calcs.sparkSession.createDataFrame(rows, "name string, level long")


def refined_kinds(calcs: DataFrame) -> DataFrame:
    """(name, kind): a column calculation that refers to a measure, through others too, is a measure."""
    kinds = {r["name"]: r["kind"] for r in calcs.select("name", calc_kind(F.col("formula")).alias("kind")).collect()}  # a row a calculation
    behind = defaultdict(set)
    for r in edges(calcs).collect():
        behind[r["source"]].add(r["target"])
    todo = [n for n, k in kinds.items() if k != "COLUMN"]
    while todo:
        for target in behind[todo.pop()]:
            if kinds.get(target) == "COLUMN":
                kinds[target] = "MEASURE"
                todo.append(target)
    return calcs.sparkSession.createDataFrame([*kinds.items()], "name string, kind string")


def dependency_kinds(calcs: DataFrame, columns: DataFrame) -> DataFrame:
    """(name, source, kind, aggregated) of every reference: CALCULATED_MEASURE, CALCULATED_COLUMN, BASE_COLUMN (of columns: column) or UNKNOWN."""
    e = edges(calcs).select(F.col("target").alias("name"), "source")
    of = refined_kinds(calcs).select(F.col("name").alias("source"), F.when(F.col("kind") == "MEASURE", "CALCULATED_MEASURE").otherwise("CALCULATED_COLUMN").alias("calculated"))
    base = columns.select(F.col("column").alias("source"), F.lit("BASE_COLUMN").alias("base")).distinct()
    kind = F.coalesce("calculated", "base", F.lit("UNKNOWN"))
    return e.join(F.broadcast(of), "source", "left").join(F.broadcast(base), "source", "left").select("name", "source", kind.alias("kind"), (kind == "CALCULATED_MEASURE").alias("aggregated"))


def dependents(calcs: DataFrame) -> DataFrame:
    """(name, n, dependents): who refers to each name, in order."""
    return edges(calcs).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("dependents"))


def roots(calcs: DataFrame) -> DataFrame:
    """(name) of calculations that refer to no other."""
    return levels(calcs).where("level <= 1").join(calcs.select("name"), "name", "left_semi").select("name")


def graph_stats(calcs: DataFrame) -> DataFrame:
    """(level, n) of all nodes."""
    return levels(calcs).groupBy("level").agg(F.count("*").alias("n"))
