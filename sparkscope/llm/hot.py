"""A join in which keys with very many rows don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot; there are fewer hot keys than this, whatever the tables.
HOT_SHARE = 1000


def joined(rows: DataFrame, facts: DataFrame, key: str, n: str, share: int = HOT_SHARE) -> DataFrame:
    """Inner join of rows with facts, a written table that has one row a key and in n the number of rows that hold it.

    Facts of hot keys, fewer than `share` by counting, are broadcast to the rows; all other keys meet in a shuffle, where none
    has more than one row in `share`. A null key joins with nothing. n is not part of the result.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = facts.where(F.col(n) * share > total)
    if hot.isEmpty():
        return rows.join(facts.drop(n), key)
    few = F.broadcast(hot.drop(n))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(facts.where(F.col(n) * share <= total).drop(n), key))
