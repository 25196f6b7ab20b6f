"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The star tables.
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str, names: list[str] = STAR) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}
