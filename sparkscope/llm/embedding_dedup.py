"""Near-duplicate embeddings by product quantisation with inverted lists.

Unit vectors with equal labels link at a cosine of at least 0.93, which is a distance of at most R. Coarse centroids and the
subspace code books are fitted on at most SAMPLE vectors, taken by a hash of their identifier; every vector is indexed. A vector is filed in the list of
its nearest centroid with the codes of its residual and the length of the quantisation error. As a query it probes its own
list and every list whose Voronoi cell comes near: (|q-c|^2 - |q-c1|^2) / (2 |c-c1|) <= R / 2, c1 the nearest centroid. The
left side is the distance to the plane halfway between c and c1. Partners in two lists lie on either side of the plane of their
centroids, and their distances to it add up to R at most, so one of them is within R / 2 and probes the other's list: no link is
missed, whatever the vectors. A link between lists that only one end probes is counted for both ends where it is found; each
row has a bit for each list it probes, to tell.

A list is what a task searches, so there are few, and each is cut into cells around centroids of its own. A query leaves out
a cell whose rows are all further than R: beyond R plus the cell's radius from its centroid, or more than R behind the plane
to the cell that the query is nearest to. In the other cells distances to the reconstructed vectors
are sums of table entries, one table a subspace; by the triangle inequality a partner's is at most R plus its error, and what
passes is compared exactly, in double precision.

Equal vectors of a label are one row with a weight. A list of more than BLOCK rows is cut into blocks by a hash, and so are
its queries: a task gets one block of each, whatever the size of the list. A block of queries gives only counts of links and
the links that connect its rows, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .components import connected_components

COSINE = 0.93
#: Vectors on which centroids and code books are fitted, whatever the size of the table.
SAMPLE = 20_000
#: Rows of the most frequent label that a list should have, and rows of a list or of its queries in a task.
LIST_ROWS, BLOCK = 4096, 4096
#: Cells of a list. A centroid, of a list or a cell, is the mean of at least LEAST_OF_LIST sample vectors on average, so the sample bounds both.
CELLS, LEAST_OF_LIST = 16, 4
#: Rows whose distances to all centroids are held at once.
CHUNK = 512
SUBSPACES, CODES = 8, 256
#: Deviations, R / (2 sqrt(dimension)) each, that the margin has at most; without a bound every partner is found.
SPREAD = math.inf
#: Added to bounds against rounding.
SLACK = 1e-5


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distances to all) of each row."""
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)
    return d.argmin(axis=1), d


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means; a centre that loses all its rows stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[s : s + CHUNK], centres)[0] for s in range(0, len(x), CHUNK)])
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _united(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """roots, where each row points at the least row that it is connected with, after rows a and b are connected pairwise."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        roots = roots.copy()
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (further := roots[roots] != roots).any():
            roots[further] = roots[roots[further]]


class Quantiser:
    """Coarse centroids, those of the cells in each list, and the code books of residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _means(sample, min(lists, len(sample)), 8, 1)
        near = np.concatenate([_nearest(sample[s : s + CHUNK], self.centres)[0] for s in range(0, len(sample), CHUNK)])
        residual = sample - self.centres[near]
        self.cells = []
        for k, centre in enumerate(self.centres):
            of_list = sample[near == k]
            n = min(CELLS, len(of_list) // LEAST_OF_LIST)
            self.cells.append(_means(of_list, n, 5, 100 + k) if n > 1 else centre[None])
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [_means(residual[:, a:b], min(CODES, len(sample)), 5, 2 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def code(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the quantisation error) of rows in the lists near."""
        residual = x - self.centres[near]
        codes = np.stack([_nearest(residual[:, a:b], book)[0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        made = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(residual - made, axis=1)

    def probes(self, near: np.ndarray, d: np.ndarray, margin: float) -> list[np.ndarray]:
        """Lists whose cells come within the margin of each row."""
        gap = d - d[np.arange(len(d)), near][:, None]
        apart = np.sqrt(_nearest(self.centres[near], self.centres)[1])
        ok = gap <= 2 * (margin + SLACK) * apart + SLACK
        ok[np.arange(len(d)), near] = True
        return [np.flatnonzero(r) for r in ok]

    def cell_of(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The cell of each row in its list."""
        cell = np.zeros(len(x), dtype=np.int32)
        for k in np.unique(near):
            cell[near == k] = _nearest(x[near == k], self.cells[k])[0]
        return cell

    def open_cells(self, q: np.ndarray, in_list: int, radius: np.ndarray, reach: float) -> np.ndarray:
        """Whether each query may have a partner in each cell; radius is negative for a cell without rows."""
        cells = self.cells[in_list]
        near, d = _nearest(q, cells)
        gap = d - d[np.arange(len(d)), near][:, None]
        apart = np.sqrt(_nearest(cells[near], cells)[1])
        return (radius >= 0)[None] & (np.sqrt(d) <= reach + radius[None] + SLACK) & (gap <= 2 * (reach + SLACK) * apart + SLACK)

    def tables(self, q: np.ndarray, in_list: int) -> list[np.ndarray]:
        """For each subspace the squared distances of its codes (rows) to the queries (columns)."""
        residual = (q - self.centres[in_list]).astype(np.float32)
        return [np.ascontiguousarray(_nearest(residual[:, a:b], book.astype(np.float32))[1].T) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def _within(tables: list[np.ndarray], codes: np.ndarray, limit: np.ndarray, rows: np.ndarray | None, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) whose table distance is at most the member's limit; rows are the queries to look at, all if None."""
    total = np.zeros((len(members), tables[0].shape[1] if rows is None else len(rows)), dtype=np.float32)
    for i, t in enumerate(tables):
        total += (t if rows is None else t[:, rows])[codes[members, i]]
    b, a = np.nonzero(total <= (limit[members] ** 2)[:, None])
    return (a if rows is None else rows[a]), members[b]


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, spread: float = SPREAD, list_rows: int = LIST_ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: other vectors linked directly, the smallest id reachable, whether that is the own.

    Null labels, null or zero vectors and vectors with null or non-finite components link with nothing and are their own
    component. Vectors of another dimension never link. Rows that repeat an id are vectors of their own. An empty table gives none.
    """
    spark, reach = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    v = F.col("v")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = rows.where(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    # One row for equal vectors of a label: rep is its smallest id, w its number of rows.
    reps = staged(sound.groupBy("label", "v", "norm").agg(F.min("id").alias("rep"), F.count("*").alias("w")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = reps.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    found = []
    for dim, n, most in sizes:
        of = reps.where(F.size("v") == dim)
        share = min(1.0, 1.2 * SAMPLE / n)
        sample = of.where(F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("rep", "v")).limit(SAMPLE).select("v", "norm").toPandas()
        if not len(sample):
            sample = of.limit(SAMPLE).select("v", "norm").toPandas()
        quantiser = spark.sparkContext.broadcast(Quantiser(np.stack(sample["v"]) / sample["norm"].to_numpy()[:, None], max(1, min(most // list_rows, len(sample) // LEAST_OF_LIST))))
        found.append(_links(of, quantiser, cosine, reach, reach / 2 * min(1.0, spread / math.sqrt(dim)), block))
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for x in found[1:]:
        links = links.unionAll(x)
    links = staged(links, "embedding-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = reps.join(counts, "node", "left").join(groups, "node", "left").select(*_names(), "rep", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("g"))
    least = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    verdicts = named.join(least, "g").select("name", "name_too", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id")
    keyed = sound.select("id", *_names()).join(verdicts, ["name", "name_too"]).select("id", "n_links", "component_id")
    sound_mark = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    alone = rows.where(~sound_mark).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return keyed.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _names() -> list:
    """128 bits that name a vector of a label, by which its rows find it again without a shuffle of vectors."""
    return [F.xxhash64("label", "v").alias("name"), F.xxhash64(F.reverse("v"), "label").alias("name_too")]


def _links(reps: DataFrame, quantiser, cosine: float, reach: float, margin: float, block: int) -> DataFrame:
    """(node, n, other): weights of vectors linked in one block of a list, and rows that connect what is linked there."""

    def file(batches):
        q = quantiser.value
        for pdf in (b.iloc[s : s + CHUNK] for b in batches for s in range(0, len(b), CHUNK)):
            x = np.stack(pdf["v"]) / pdf["norm"].to_numpy()[:, None]
            near, d = _nearest(x, q.centres)
            codes, error = q.code(x, near)
            probes = q.probes(near, d, margin)
            bits = np.zeros((len(x), len(q.centres)), dtype=bool)
            for row, p in zip(bits, probes):
                row[p] = True
            yield pd.DataFrame({"node": pdf["node"], "label": pdf["label"], "w": pdf["w"], "v": pdf["v"], "norm": pdf["norm"], "list": near.astype(np.int32), "cell": q.cell_of(x, near), "codes": [c.tobytes() for c in codes], "error": error, "probes": [p.astype(np.int32) for p in probes], "bits": [p.tobytes() for p in np.packbits(bits, axis=1)]})

    filed = staged(reps.select("node", "label", "w", "v", "norm").mapInPandas(file, "node long, label string, w long, v array<double>, norm double, list int, cell int, codes binary, error double, probes array<int>, bits binary"), "lists")
    members = filed.groupBy("label", "list").agg(F.count("*").alias("n_members"))
    probing = filed.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.count("*").alias("n_queries"))
    blocks = members.join(probing, ["label", "list"]).select("label", "list", F.ceil(F.col("n_members") / block).cast("int").alias("mb"), F.ceil(F.col("n_queries") / block).cast("int").alias("qb"))
    salt = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_members = filed.join(blocks, ["label", "list"]).select("label", "list", salt("mb").alias("m"), "node", "w", "v", "norm", F.col("list").alias("home"), "cell", "codes", "error", "bits", "qb").select("*", each("qb").alias("q")).drop("qb")
    as_queries = filed.select("node", "w", "v", "norm", "label", F.col("list").alias("home"), F.explode("probes").alias("list")).join(blocks, ["label", "list"]).select("label", "list", salt("qb").alias("q"), "node", "w", "v", "norm", "home", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("binary").alias("bits"), "mb").select("*", each("mb").alias("m")).drop("mb")

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        qz, is_member = quantiser.value, pdf["codes"].notna().to_numpy()
        m, q = pdf[is_member], pdf[~is_member]
        if not len(m) or not len(q):
            return pd.DataFrame({"node": [], "n": [], "other": []})
        xm, xq = np.stack(m["v"]), np.stack(q["v"])
        nm, nq = m["norm"].to_numpy(), q["norm"].to_numpy()
        codes, limit = np.frombuffer(b"".join(m["codes"]), dtype=np.uint8).reshape(len(m), -1), reach + m["error"].to_numpy() + SLACK
        node_m, node_q, w, w_q = m["node"].to_numpy(), q["node"].to_numpy(), m["w"].to_numpy(), q["w"].to_numpy()
        home, bits = q["home"].to_numpy(), np.frombuffer(b"".join(m["bits"]), dtype=np.uint8).reshape(len(m), -1)
        names, at_name = np.unique(np.concatenate([node_q, node_m]), return_inverse=True)
        of_q, of_m, roots = at_name[: len(q)], at_name[len(q) :], np.arange(len(names))
        counts, back = np.zeros(len(q), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
        in_list, cell = int(key[1]), m["cell"].to_numpy().astype(int)
        radius = np.full(len(qz.cells[in_list]), -1.0)
        np.maximum.at(radius, cell, np.linalg.norm(xm / nm[:, None] - qz.cells[in_list][cell], axis=1))
        for s in range(0, len(q), 256):
            u = xq[s : s + 256] / nq[s : s + 256, None]
            tables, look = qz.tables(u, in_list), qz.open_cells(u, in_list, radius, reach)
            often = look.mean(axis=0) > 0.5  # such cells are searched for all queries at once
            found = [_within(tables, codes, limit, None, np.flatnonzero(often[cell]))]
            found += [_within(tables, codes, limit, np.flatnonzero(look[:, c]), np.flatnonzero(cell == c)) for c in np.flatnonzero(look.any(axis=0) & ~often)]
            i, j = (np.concatenate(x) for x in zip(*found))
            for t in range(0, len(i), 1 << 16):
                a, b = i[t : t + (1 << 16)] + s, j[t : t + (1 << 16)]
                cos = np.einsum("ij,ij->i", xq[a], xm[b]) / (nq[a] * nm[b])
                ok = (cos >= cosine) & (node_q[a] != node_m[b])
                a, b = a[ok], b[ok]
                np.add.at(counts, a, w[b])
                unseen = bits[b, home[a] >> 3] >> (7 - (home[a] & 7)) & 1 == 0  # the member doesn't probe the query's list
                np.add.at(back, b[unseen], w_q[a[unseen]])
                roots = _united(roots, of_q[a], of_m[b])
        tied = np.flatnonzero(roots != np.arange(len(names)))
        some, more = np.flatnonzero(counts), np.flatnonzero(back)
        return pd.DataFrame({"node": np.concatenate([node_q[some], node_m[more], names[tied]]), "n": np.concatenate([counts[some], back[more], np.zeros(len(tied), dtype=np.int64)]), "other": pd.array([*[None] * (len(some) + len(more)), *names[roots[tied]].tolist()], dtype="Int64")})

    return as_members.unionByName(as_queries).groupBy("label", "list", "m", "q").applyInPandas(search, "node long, n long, other long")


def op7(spark, sf_dir):
    return embedding_components(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
