"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Vectors are turned into integers, and equal ones become one row with a weight. Each round is one pass over the distinct
vectors without a shuffle of them: a task finds the nearest centroid of each and sums components times weights, as integers, and
only these sums meet, k times the dimension a task. All arithmetic is exact, so the result is the same for any partitions.
At the end the assignments of distinct vectors are joined back to the rows; vectors with very many copies are not dealt out by
their value there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, fresh_path, staged, table
from .hot import joined

#: Largest size of a quantised component: squared distances of 64 such components stay below 2**63.
LARGEST = 1 << 27
#: Distinct vectors whose distances a task holds at once.
CHUNK = 4096
#: Of the rows in hash order, this multiple of k is looked at for the first centroids.
SURPLUS = 16


def quantised(vector: Column, dimension: int, scale: int) -> Column:
    """floor(scale * x) of each component; null unless there are exactly `dimension` of them, none null or non-finite."""
    v = vector.cast("array<double>")
    sound = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equals; squared distance), exactly."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = np.float64 if 4 * q.shape[1] * most * most < 1 << 53 else np.int64
    x, c = q.astype(exact), centroids.astype(exact)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
    near = d.argmin(axis=1)
    return near, d[np.arange(len(d)), near].astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            b = whole.slice(at, CHUNK)
            yield b, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, component, total, n) of each non-empty cluster and component."""
    k, dimension = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches):
        totals, n = np.zeros((k, dimension), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b, q in _vectors(batches, dimension):
            w = b.column(1).to_numpy()
            near, _ = nearest(q, centroids)
            order = np.argsort(near, kind="stable")
            some, start = np.unique(near[order], return_index=True)
            totals[some] += np.add.reduceat((q * w[:, None])[order], start, axis=0)
            n[some] += np.add.reduceat(w[order], start)
        some = np.flatnonzero(n)
        yield batch(schema, np.repeat(some, dimension), np.tile(np.arange(dimension), len(some)), totals[some].ravel(), np.repeat(n[some], dimension))

    parts = distinct.select("q", "w").mapInArrow(run, "cluster int, component int, total long, n long")
    return parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def _starts(rows: DataFrame, n: int, k: int, seed: str) -> np.ndarray:
    """The k vectors whose hashes come first. Hashes are uniform, so a cut finds them among few; rows that repeat identifiers may need a look at all."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    order = [F.col("h").asc_nulls_last(), F.col("q")]
    cut = f"{min((1 << 60) - 1, SURPLUS * k * (1 << 60) // n):015x}"
    found = first.where(F.col("h") <= cut).orderBy(*order).limit(k).collect()
    if len(found) < min(k, n):
        found = first.orderBy(*order).limit(k).collect()
    return np.array([r["q"] for r in found], dtype=np.int64)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row whose vector is sound.

    Vectors that are null, of another dimension, or hold null or non-finite components have no row. Centroids start as the k
    vectors with the smallest sha256 of `seed:id`; null identifiers come last there, equal hashes by their vectors, and fewer
    rows than k give fewer centroids. Equal centroids stay apart: the smaller number gets the rows, the other stays where it is.
    Repeated rows count each. An empty table gives an empty one. A ValueError says that components reach LARGEST after
    scaling or that sums could pass a long.
    """
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dimension, scale).alias("q")).where("q is not null")
    distinct = staged(rows.groupBy("q").agg(F.count("*").alias("w")), "distinct-vectors")
    n, low, high = distinct.agg(F.sum("w"), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    if n and (max(-low, high) > LARGEST or n * max(-low, high) >= 1 << 62):
        raise ValueError("components are too large for sums in 64 bits; choose a smaller scale")
    centroids = _starts(rows, n, k, seed) if n else np.zeros((0, dimension), dtype=np.int64)
    for _ in range(rounds if n else 0):
        new = centroids.copy()
        for r in _sums(distinct, centroids):
            new[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
        if (new == centroids).all():
            break  # further rounds change nothing
        centroids = new

    def run(batches):
        schema = pa.schema([("q", pa.list_(pa.int64())), ("w", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for b, q in _vectors(batches, dimension):
            near, d = nearest(q, centroids)
            yield batch(schema, b.column(0).cast(schema.types[0]), b.column(1), near, d)

    path = fresh_path(vectors.sparkSession, "assigned")
    assigned = staged(distinct.select("q", "w").mapInArrow(run, "q array<long>, w long, cluster int, distance long"), "assigned", path=path)
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row a cluster, k at most.
    facts = vectors.sparkSession.createDataFrame([(c, s, sum(inertia.values()), digests[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return joined(rows, assigned, "q", "w").drop("q").join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir):
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _op11_sql(rounds: int = 5) -> str:
    ctes = [
        "v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "q AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM v)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS m FROM (SELECT q, sha256('2:' || vec_id) AS h FROM q ORDER BY h, q LIMIT 40))",
    ]
    near = "SELECT vec_id, q, arg_min(struct_pack(c := c, d := d), (d, c)) AS b FROM (SELECT vec_id, q, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q, c{0}) GROUP BY vec_id, q"
    for i in range(rounds):
        ctes += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"s{i} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(range(64)) AS p, unnest(q) AS x FROM a{i}) GROUP BY c, p)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(g.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM s{i} GROUP BY c) g ON g.c = c{i}.c)",
        ]
    ctes.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ",\n".join(ctes) + (
        "\nSELECT a.vec_id, CAST(a.b.c AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON c{rounds}.c = a.b.c"
    )


OP11_SQL = _op11_sql()
