"""Models over tables: joins by relationships, cardinality, facts and dimensions, the calendar."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .profile import generic_type, uniqueness

FACT_ROWS, FACT_DENSITY, DIMENSION_ROWS, DIMENSION_DENSITY, KEY_CARDINALITY = 100_000, 0.5, 10_000, 0.3, 0.99


def joined(fact: DataFrame, *dims: tuple[DataFrame, str, str], how: str = "left") -> DataFrame:
    """fact with dimensions by (table, column so far, column of the table); Spark broadcasts the small ones by their size."""
    for dim, here, there in dims:
        fact = fact.join(dim, F.col(here) == dim[there], how)
    return fact


def blended(primary: DataFrame, secondary: DataFrame, link: list[str], measures: dict[str, Column]) -> DataFrame:
    """A secondary source aggregated to the linking fields, then joined to the primary."""
    return primary.join(secondary.groupBy(*link).agg(*[m.alias(n) for n, m in measures.items()]), link, "left")


def many_to_many(a: DataFrame, b: DataFrame, key: str, left: dict[str, Column], right: dict[str, Column]) -> DataFrame:
    """Measures of two tables by a key that repeats in both: each side is aggregated first, so no row counts twice."""
    return a.groupBy(key).agg(*[m.alias(n) for n, m in left.items()]).join(b.groupBy(key).agg(*[m.alias(n) for n, m in right.items()]), key)


def key_ratio(df: DataFrame, column: str) -> DataFrame:
    """One row: non-null rows and distinct values of a key."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))


def model_relationship(a: DataFrame, column1: str, b: DataFrame, column2: str) -> DataFrame:
    """One row (cardinality, filter_direction) by whether each side's values are unique."""
    one = lambda df, c, k: key_ratio(df, c).select((F.col("rows") == F.col("distinct")).alias(k))
    both = one(a, column1, "u1").join(F.broadcast(one(b, column2, "u2")))  # one row each
    kind = F.when(F.col("u1") & F.col("u2"), "OneToOne").when(F.col("u1"), "OneToMany").when(F.col("u2"), "ManyToOne").otherwise("ManyToMany")
    return both.select(kind.alias("cardinality")).withColumn("filter_direction", F.when(F.col("cardinality") == "ManyToMany", "Both").otherwise("Single"))


def cardinality_by_name(source: str, target: str) -> str:
    """By the ends of the columns' names, where the tables aren't at hand."""
    key = lambda c: c.lower().endswith(("id", "key", "code", "pk"))
    return "ManyToOne" if key(target) or not key(source) else "OneToMany"


def active_relationships(edges: DataFrame) -> DataFrame:
    """Of several relationships between the same tables (from, to, seq) the first is active."""
    w = Window.partitionBy("from", "to").orderBy("seq")
    return edges.withColumn("active", F.row_number().over(w) == 1)


def classified(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count, column_count, numeric_density, classification, confidence): by rows and the share of numeric columns, rows counted in full."""

    def one(name: str, df: DataFrame) -> DataFrame:
        numeric = sum(generic_type(f.dataType) == "NUMERIC" for f in df.schema)
        return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), F.round(F.lit(numeric / len(df.columns)), 4).alias("numeric_density"))

    rows = reduce(DataFrame.unionByName, [one(t, df) for t, df in tables.items()])
    fact = (F.col("row_count") > FACT_ROWS) & (F.col("numeric_density") > FACT_DENSITY)
    dimension = (F.col("row_count") < DIMENSION_ROWS) & (F.col("numeric_density") < DIMENSION_DENSITY)
    return rows.select("*", F.when(fact, "FACT").otherwise("DIMENSION").alias("classification"), F.when(fact, 95).when(dimension, 98).otherwise(70).cast("long").alias("confidence"))


def likely_key(df: DataFrame) -> DataFrame:
    """(column, cardinality): the first column nearly all of whose values differ."""
    order = F.array_position(F.array(*map(F.lit, df.columns)), F.col("column"))
    return uniqueness(df).where(F.col("cardinality") >= KEY_CARDINALITY).orderBy(order).limit(1).select("column", "cardinality")


def calendar(spark: SparkSession, first: str, last: str, fiscal_start: int | None = None) -> DataFrame:
    """A row a day from first to last, with the usual parts and, from a first month on, fiscal ones."""
    d = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS Date")
    date, month = F.col("Date"), F.month("Date")
    long = lambda c: c.cast("long")
    out = d.select(
        "Date", long(F.year(date)).alias("Year"), long(F.quarter(date)).alias("QuarterNumber"), F.concat(F.lit("Q"), F.quarter(date)).alias("Quarter"), long(month).alias("MonthNumber"), F.date_format(date, "MMMM").alias("MonthName"),
        F.date_format(date, "MMM").alias("MonthShort"), F.date_format(date, "yyyy-MM").alias("YearMonth"), long(F.weekofyear(date)).alias("WeekNumber"), long(F.dayofmonth(date)).alias("Day"), long(F.dayofyear(date)).alias("DayOfYear"),
        long(F.weekday(date) + 1).alias("WeekdayNumber"), F.date_format(date, "EEEE").alias("Weekday"), (F.weekday(date) >= 5).alias("IsWeekend"),
    )
    if fiscal_start is None:
        return out
    shifted = (F.col("MonthNumber") - fiscal_start + 12) % 12
    return out.select("*", (F.col("Year") + ((F.col("MonthNumber") >= fiscal_start) & F.lit(fiscal_start > 1)).cast("long")).alias("FiscalYear"), (F.floor(shifted / 3) + 1).alias("FiscalQuarter"), (shifted + 1).alias("FiscalMonth"))


def by_name_keywords(table: Column) -> Column:
    """FACT or DIMENSION by words in a table's name, DIMENSION without any."""
    return F.when(F.lower(table).rlike("fact|sales|order|transaction|lineitem|event"), "FACT").otherwise("DIMENSION")


def rollup(df: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Totals along a drill path: one row for each level's groups, and the grand total."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level_mask"), *[m.alias(n) for n, m in measures.items()])


def with_calendar(fact: DataFrame, date: str, days: DataFrame) -> DataFrame:
    """A fact with the calendar's columns of its date; rows without a date, or with one outside, keep nulls."""
    return fact.join(F.broadcast(days), F.to_date(date) == F.col("Date"), "left")  # a row a day


def totals(classes: DataFrame) -> DataFrame:
    """One row: tables, rows, facts, dimensions of classified tables."""
    kind = F.col("classification")
    return classes.agg(F.count("*").alias("tables"), F.sum("row_count").alias("rows"), F.count_if(kind == "FACT").alias("facts"), F.count_if(kind == "DIMENSION").alias("dimensions"))
