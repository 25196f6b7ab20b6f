"""State tables of jobs: look-ups, joins, histories of changes, deletions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence over which a validation counts as passed whatever its status.
PASSED = 0.95


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def look_up(rows: DataFrame, keys: dict, order: str) -> DataFrame:
    """Rows that have all the keys, nulls by is null, in order."""
    return rows.where(_all([F.col(c).eqNullSafe(F.lit(v)) for c, v in keys.items()])).orderBy(order)


def exists(rows: DataFrame, keys: dict) -> DataFrame:
    """One row: whether some row has the keys; reading ends with the first."""
    found = rows.where(_all([F.col(c).eqNullSafe(F.lit(v)) for c, v in keys.items()])).limit(1)
    return found.agg((F.count("*") > 0).alias("found"))


def with_parent(rows: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that have a parent, with some of its columns."""
    return rows.join(parents.select(key, *columns), key, "inner")


def grouped(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n, items): the rows of each key as a sorted list of structs, for keys of few rows such as the slices of a conversion."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def current(changes: DataFrame, key: str, ts: str, status: str, running: str, ended: list[str]) -> DataFrame:
    """The state after all changes of each key, with started_at and completed_at.

    A change is a row that names some columns and leaves the others null; the last value named of each column holds.
    started_at is the first time of the running status, completed_at the last of one that ends a job.
    """
    others = [c for c in changes.columns if c not in (key, ts)]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in others]
    return changes.groupBy(key).agg(*last, F.min(F.when(F.col(status) == running, F.col(ts))).alias("started_at"), F.max(F.when(F.col(status).isin(ended), F.col(ts))).alias("completed_at"))


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What is left of rows when the parents that aren't there have been deleted."""
    return rows.join(parents.select(key), key, "left_semi")


@dataclass(frozen=True)
class Reference:
    """Rows of child that name a row of parent by a column; what becomes of them when it is deleted: they go (cascade), lose the name (set null), or forbid it (restrict)."""

    child: str
    child_column: str
    parent: str
    parent_column: str
    action: str = "cascade"


def parents_first(tables: list[str], references: list[Reference]) -> list[str]:
    """The tables so that each comes after all that it refers to. A ValueError names tables that refer to each other in a circle."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(r.child == t and r.parent in left for r in references)]
        if not free:
            raise ValueError(f"circular references among {', '.join(left)}")
        out += free
        left = [t for t in left if t not in free]
    return out


def cascade(tables: dict[str, DataFrame], references: list[Reference], deleted: dict[str, Column]) -> dict[str, DataFrame]:
    """What is left of each table when the rows of `deleted`, a condition a table, go with all that hangs on them.

    The closure is taken parents first. Rows whose reference is null or names nobody stay; a null condition deletes nothing.
    A table with several parents loses the rows of any. Each table has the columns it had. A ValueError says that a restricted reference
    is in the way, or that references are circular.
    """
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for t in parents_first([*tables], references):
        df = tables[t].withColumn("_gone", F.coalesce(deleted.get(t, F.lit(False)), F.lit(False)))
        for i, r in enumerate(r for r in references if r.child == t and r.parent in gone):
            # Keys of deleted parents, each once, so that no row of the child is repeated.
            keys = gone[r.parent].select(F.col(r.parent_column).alias(f"_key{i}")).where(f"_key{i} is not null").distinct()
            df = df.join(keys, F.col(r.child_column) == F.col(f"_key{i}"), "left")
            hit = F.col(f"_key{i}").isNotNull()
            if r.action == "restrict" and not df.where(hit & ~F.col("_gone")).isEmpty():
                raise ValueError(f"{t}.{r.child_column} still refers to {r.parent}")
            if r.action == "set null":
                df = df.withColumn(r.child_column, F.when(~hit, F.col(r.child_column)))
            elif r.action == "cascade":
                df = df.withColumn("_gone", F.col("_gone") | hit)
            df = df.drop(f"_key{i}")
        if t in deleted or any(r.child == t and r.parent in gone for r in references):
            gone[t] = df.where("_gone").select(*tables[t].columns)
        left[t] = df.where("not _gone").select(*tables[t].columns)
    return left


def of_status(rows: DataFrame, status: str, wanted: list[str]) -> DataFrame:
    """(status, n): rows of each wanted status."""
    return rows.where(F.col(status).isin(wanted)).groupBy(status).agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, values): the values of each key, each once, in the order in which they first came; for few kinds of values."""
    once = rows.groupBy(key, value).agg(F.min(at).alias("_at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def kept_after(rows: DataFrame, ts: str, now: Column, days: int, ended: Column | None = None) -> DataFrame:
    """Rows that a clean-up leaves: those younger than so many days and those that haven't ended."""
    old = F.col(ts) < now - F.make_dt_interval(F.lit(days))
    return rows.where(~F.coalesce(old if ended is None else old & ended, F.lit(False)))


def flagged(rows: DataFrame, key: str, excluded: list, name: str = "deleted") -> DataFrame:
    """Rows with a mark of those that a person took out; they stay and can be taken in again."""
    return rows.withColumn(name, F.coalesce(F.col(key).isin(excluded), F.lit(False)))


def recent(rows: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """The last n rows of each key by time, newest first. Tasks keep n a key before the shuffle's ranking."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def reported_status(confidence: Column, status: Column) -> Column:
    """Passed over PASSED of confidence, else by the status: passed, failed, pending or not validated."""
    s = F.lower(status)
    return F.when(confidence > PASSED, "Passed").when(s.isin("passed", "valid", "success"), "Passed").when(s.isin("failed", "invalid", "error"), "Failed").when(s.isin("pending", "running"), "Pending").otherwise("Not validated")
