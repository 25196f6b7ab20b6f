"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, staged

#: Rounds after which something is wrong: each shortens paths by more than a half, so 2**60 nodes settle before.
MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link between two different nodes; component is its smallest reachable node.

    Each round moves links towards the smallest neighbour. Only one row a link is kept, hubs are pre-aggregated by the
    minimum, and the join that hands it out is one that adaptive execution can split. Null ends and self-links are ignored;
    an empty table gives an empty one. Each round is a written table, so a lost executor costs one round at most; a table
    goes when the next is complete. A RuntimeError says that the links did not settle.
    """
    path = fresh_path(links.sparkSession, "links")
    stars = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links", path=path)
    mark = None
    for _ in range(MOST_ROUNDS):
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, path = path, fresh_path(links.sparkSession, "stars")
        stars = staged(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "stars", path=path)
        discard(old)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
