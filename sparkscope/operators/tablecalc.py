"""Table calculations: windows over a view that is already aggregated to its dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written


def addressed(partition: list[str], order: list[str]) -> WindowSpec:
    """Restarting for each combination of partition, going along order."""
    return Window.partitionBy(*partition).orderBy(*order)


def running(aggregate, x: str, partition: list[str], order: list[str]) -> Column:
    """A running aggregate up to the current mark, its peers included."""
    return aggregate(x).over(addressed(partition, order).rangeBetween(Window.unboundedPreceding, Window.currentRow))


def moving(aggregate, x: str, first: int, last: int, partition: list[str], order: list[str]) -> Column:
    """An aggregate from first to last marks relative to the current one."""
    return aggregate(x).over(addressed(partition, order).rowsBetween(first, last))


def whole(aggregate, x: str, partition: list[str]) -> Column:
    return aggregate(x).over(Window.partitionBy(*partition))


def ranks(x: str, partition: list[str], ties: list[str]) -> dict[str, Column]:
    """Descending ranks: competition, dense, unique (ties by the other columns), and percentile."""
    w = Window.partitionBy(*partition).orderBy(F.desc(x))
    return {"rank": F.rank().over(w).cast("long"), "rank_dense": F.dense_rank().over(w).cast("long"), "rank_unique": F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(x), *ties)).cast("long"), "rank_percentile": F.percent_rank().over(w)}


def share(x: str, partition: list[str]) -> Column:
    """Part of the partition's total; 0 where that is 0."""
    return F.coalesce(F.try_divide(F.col(x), F.sum(x).over(Window.partitionBy(*partition))), F.lit(0.0))


def lookup(x: str, offset: int, partition: list[str], order: list[str]) -> Column:
    """The value so many marks away, null beyond the partition."""
    w = addressed(partition, order)
    return F.lag(x, -offset).over(w) if offset < 0 else F.lead(x, offset).over(w)


def difference(x: str, partition: list[str], order: list[str]) -> Column:
    return F.col(x) - lookup(x, -1, partition, order)


def percent_change(x: str, partition: list[str], order: list[str]) -> Column:
    """Change against the mark before in parts of it; 0 where there is none or it is 0."""
    before = lookup(x, -1, partition, order)
    return F.coalesce(F.try_divide(F.col(x) - before, before), F.lit(0.0))


def positions(partition: list[str], order: list[str]) -> dict[str, Column]:
    """INDEX, SIZE and the offsets FIRST and LAST to the ends of the partition."""
    at, size = F.row_number().over(addressed(partition, order)).cast("long"), F.count("*").over(Window.partitionBy(*partition))
    return {"index": at, "size": size, "first": 1 - at, "last": size - at}


def month_before(view: DataFrame, month: str, x: str, keys: list[str], out: str) -> DataFrame:
    """Adds x of the calendar month before, null where the view has none: a join, so gaps in the months count."""
    before = view.select(*keys, F.add_months(month, 1).alias(month), F.col(x).alias(out))
    return view.join(before, [*keys, month], "left")


def row_numbers(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """df with a global index from 1 along order, without a window over one task.

    Rows are range-sorted and written once, each with its partition and its place there; the partitions' sizes, a row each, then
    give the offsets. Counting and numbering read the same written rows, so they agree however the sort was planned. Rows with
    equal order get neighbouring numbers in some order; nulls come first; an empty table stays empty.
    """
    part, at, start = (f"_{k}_{uuid.uuid4().hex[:8]}" for k in ("part", "at", "start"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), at: place})
    rows = written(tagged, "row-numbers")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(F.col(part), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(start))  # a row a partition
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(at) + 1).drop(part, at, start)
