"""Exact quantiles of any number of rows and any orders at once, by ranks over a range-partitioned table of values."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def quantiles(df: DataFrame, keys: list[str], value: Column, orders: dict[str, float], discrete: bool = False) -> DataFrame:
    """keys with a column for each of orders, a name and a probability: the value at that rank of each group, 0 the least and 1 the greatest.

    Between two ranks it is interpolated in a straight line; discrete takes the first value at or above the rank's share
    of rows. Values are counted map-side, so a repeated value is one row, and range-sorted once for all orders; the sizes of
    the ranges tell which of them hold a wanted rank of a group, and only these are summed up value by value. Null values don't
    count, a group of nothing else has null quantiles; null keys are a group; NaN is greater than any number. Without keys
    there is one row, also for an empty table.
    """
    if bad := [q for q in orders.values() if not 0 <= q <= 1]:
        raise ValueError(f"not a probability: {bad[0]}")
    own = [f"k{i}" for i in range(len(keys))] or ["k0"]
    named = [F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)] or [F.lit(0).alias("k0")]
    counted = df.select(*named, value.cast("double").alias("v")).groupBy(*own, "v").agg(F.count("v").alias("n"))
    ranges = written(counted.repartitionByRange(*own, "v").withColumn("part", F.spark_partition_id()), "quantiles")
    sizes = ranges.groupBy(*own, "part").agg(F.sum("n").alias("size"))
    group = Window.partitionBy(*own)  # a row a range
    placed = sizes.select(*[F.col(o).alias(f"of_{o}") for o in own], F.col("part").alias("of_part"), "size", (F.sum("size").over(group.orderBy("part")) - F.col("size")).alias("start"), F.sum("size").over(group).alias("total"))
    total = F.col("total")

    def ends(q: float) -> list[Column]:
        """The ranks, from 0, between which the quantile lies."""
        if discrete:
            return [F.greatest(F.ceil(total * F.lit(float(q))) - 1, F.lit(0))]
        at = (total - 1) * F.lit(float(q))
        return [F.floor(at), F.ceil(at)]

    wanted = [r for q in orders.values() for r in ends(q)]
    held = reduce(or_, [(r >= F.col("start")) & (r < F.col("start") + F.col("size")) for r in wanted])
    same = reduce(and_, [F.col(o).eqNullSafe(F.col(f"of_{o}")) for o in own], F.col("part") == F.col("of_part"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(*own, "part").orderBy("v"))
    ranked = ranges.where("n > 0").join(placed.where(held), same).withColumn("upto", upto)
    at = lambda r: F.min(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v")))
    taken = ranked.groupBy(*own).agg(F.max("total").alias("total"), *[at(r).alias(f"r{i}") for i, r in enumerate(wanted)])
    out, step = [], 1 if discrete else 2
    for i, (name, q) in enumerate(orders.items()):
        low, high = F.col(f"r{i * step}"), F.col(f"r{i * step + step - 1}")
        share = (total - 1) * F.lit(float(q)) - F.floor((total - 1) * F.lit(float(q)))
        out.append(F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share).alias(name))
    groups = ranges.select(*own).distinct().select(*[F.col(o).alias(f"of_{o}") for o in own]) if keys else df.sparkSession.range(1).select(F.lit(0).alias("of_k0"))
    on = reduce(and_, [F.col(o).eqNullSafe(F.col(f"of_{o}")) for o in own])
    return groups.join(taken, on, "left").select(*[F.col(f"of_{o}").alias(k) for o, k in zip(own, keys)], *out)


def medians(df: DataFrame, keys: list[str], value: Column, name: str = "median") -> DataFrame:
    """(keys, median): of each group the middle value, or the mean of the two middle ones."""
    return quantiles(df, keys, value, {name: 0.5})
