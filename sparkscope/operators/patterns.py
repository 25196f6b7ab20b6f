"""A library of patterns as rows (id, tags, difficulty, formula, target, notes): search, summary, suggestions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import token_ratio_udf

SCHEMA = "id: string, tags: array<string>, difficulty: string, formula: string, target: string, notes: string"
#: Likeness that a best match must reach.
LEAST = 0.6


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of JSON files: lists of objects or one a line."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", f"array<struct<{SCHEMA}>>")).alias("p")).select("p.*")


def by_id(patterns: DataFrame, id_: str) -> DataFrame:
    return patterns.where(F.col("id") == id_)


def by_tags(patterns: DataFrame, tags: list[str], all_of: bool = False) -> DataFrame:
    """Patterns with one of the tags, or with all."""
    wanted = F.array(*map(F.lit, tags))
    return patterns.where(F.size(F.array_except(wanted, "tags")) == 0 if all_of else F.arrays_overlap("tags", wanted))


def by_difficulty(patterns: DataFrame, difficulty: str) -> DataFrame:
    return patterns.where(F.lower("difficulty") == difficulty.lower())


def search(patterns: DataFrame, words: str) -> DataFrame:
    """Patterns whose formula, target or notes hold the words, whatever their case."""
    text = F.lower(F.concat_ws("\n", "formula", "target", "notes"))
    return patterns.where(text.contains(words.lower()))


def summary(patterns: DataFrame) -> DataFrame:
    """(tag, n, difficulties): patterns by tag, and the difficulties among them."""
    return patterns.select(F.explode("tags").alias("tag"), "difficulty").groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("difficulty")), ",").alias("difficulties"))


def suggestions(patterns: DataFrame, formula: str, n: int = 3, least: float = LEAST) -> DataFrame:
    """(id, likeness): the n patterns whose formulas are most alike, best first, at least so much."""
    made = patterns.select("id", F.round(token_ratio_udf("formula", F.lit(formula)), 6).alias("likeness"))
    return made.where(F.col("likeness") >= least).orderBy(F.desc("likeness"), "id").limit(n)


def prompt(patterns: DataFrame, n: int = 20) -> str:
    """The first n patterns as text for a person or a model."""
    return "\n".join(json.dumps(r.asDict(), ensure_ascii=False) for r in patterns.orderBy("id").limit(n).collect())
