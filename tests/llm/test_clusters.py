import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.llm import hot
from sparkscope.llm.clusters import LARGEST, centroid_clusters, nearest

SCHEMA = "vec_id long, embedding array<double>, cluster string, q int, w int, id int"


def brute(rows, k, rounds, dim, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [q for _, q in by_hash[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        near = [j for _, j in assigned()]
        for j in range(len(centroids)):
            own = [q for (_, q), n in zip(kept, near) if n == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    inertia = {}
    for d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2, 3) for i, v in rows], SCHEMA)


def case(n=300, dim=4):
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-3, 4, size=dim) / 7 + 0.01 * (i % 3)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a vector with a third of all rows
    return rows + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[8][1]), (None, None), (2000, None), (2001, []), (2002, [0.0] * (dim + 1)), (2003, [None] * dim), (2004, [float("nan")] * dim), (2005, [float("inf")] * dim), (2006, [0.0] * dim), (2007, [-1e-300] * dim)]


@pytest.mark.parametrize(("k", "rounds", "parts"), [(5, 5, 1), (5, 5, 7), (40, 2, 3), (1, 3, 2), (3, 0, 2)])
def test_matches_brute_force_whatever_the_partitions(spark, k, rounds, parts):
    rows = case()
    got = centroid_clusters(made(spark, rows).repartition(parts), k=k, rounds=rounds, dimension=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, rounds, 4)


def test_more_centroids_than_rows_and_equal_ones(spark):
    rows = [(i, [0.5, 0.25]) for i in range(6)] + [(9, [3.0, -1.0])]
    got = centroid_clusters(made(spark, rows), k=40, dimension=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 40, 5, 2)
    assert len({r["cluster"] for r in got}) == 2


def test_rows_that_share_an_id_still_give_all_centroids(spark):
    rows = [(1, [float(i), 0.0]) for i in range(500)] + [(2, [1.0, 2.0])]
    got = centroid_clusters(made(spark, rows), k=40, rounds=1, dimension=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 40, 1, 2)


def test_empty_tables_and_too_large_components(spark):
    assert centroid_clusters(made(spark, case()).limit(0)).collect() == []
    assert centroid_clusters(made(spark, [(1, None), (2, [1.0])]), dimension=4).collect() == []
    with pytest.raises(ValueError):
        centroid_clusters(made(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), dimension=2)


def test_nearest_is_exact_where_doubles_are_not():
    q = np.array([[LARGEST, -LARGEST], [LARGEST - 1, -LARGEST]], dtype=np.int64)
    near, d = nearest(q, np.array([[-LARGEST, LARGEST], [LARGEST - 1, 1 - LARGEST]], dtype=np.int64))
    assert near.tolist() == [1, 1] and d.tolist() == [2, 1]


def test_join_with_hot_keys_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") == 4, None).otherwise(F.col("id")).alias("key"), "id")
    facts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    got = hot.joined(rows, facts, "key", "n", share=5)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    want = rows.join(facts.drop("n"), "key")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 2999
