"""Ranked lexical search with MaxScore: the best documents for each item of a query table.

Documents are indexed in shards, one row of a written table each: postings of the terms that the queries hold, by term and
document, and document lengths. Sums over the shards give the collection's statistics, and these each term's weight. A shard then
knows the greatest score that each of its lists can give. For a query, lists are put in order of this bound; those whose bounds
together stay below the score of the task's k-th best document so far are non-essential: a document that holds no other term can't
enter. Candidates come from the essential lists alone, block by block, and a non-essential list is looked up, largest bound
first, only for candidates that can still qualify with all bounds that are left. A task keeps k documents a query over all its shards, so
the bound rises, and only these meet with those of other tasks. Nothing is approximate, equal scores included.

Queries come in blocks of about BLOCK_BYTES of text, whose terms and weights go to every task; each block has its own
pass over the documents.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh_path, map_batches, staged, table
from .decontaminate import words

TOP = 50
#: Bytes of query texts in one pass over the documents.
BLOCK_BYTES = 2 << 20
#: Documents and postings that a shard has at most (one document more), documents whose scores are added up at once.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 8192, 2_000_000, 2048
#: Groups in which the tasks' best documents of a query meet first.
GROUPS = 64

_INDEX = "n_docs long, n_terms long, lengths array<long>, terms array<int>, dfs array<long>, docs_of binary, tfs binary"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


class _Postings:
    """What a shard gathers."""

    def __init__(self):
        self.ids, self.lengths, self.n_docs, self.n_terms = [], [], 0, 0
        self.term, self.doc, self.tf = array("i"), array("i"), array("i")

    def row(self, id_type: pa.DataType) -> pa.RecordBatch:
        term, doc, tf = (np.frombuffer(a, dtype=np.int32) for a in (self.term, self.doc, self.tf))
        order = np.argsort(term, kind="stable")
        terms, dfs = np.unique(term, return_counts=True)
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], id_type)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(self.lengths, pa.int64()), pa.array(terms, pa.int32()), pa.array(dfs, pa.int64()))]
        arrays = [lists[0], pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()), *lists[1:], pa.array([doc[order].tobytes()], pa.binary()), pa.array([tf[order].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["ids", *_NAMES])


def _indexed(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], shard_docs: int) -> Iterator[pa.RecordBatch]:
    known, shard, id_type = set(vocabulary), _Postings(), None
    for b in batches:
        id_type, some = b.column(0).type, []
        for i, text in enumerate(b.column(1).to_pylist()):
            found = words(text)
            if not found:
                continue
            shard.n_docs += 1
            shard.n_terms += len(found)
            counts = Counter(found)
            if both := known & counts.keys():
                at = len(shard.lengths)
                shard.lengths.append(len(found))
                some.append(i)
                shard.term.extend([vocabulary[t] for t in both])
                shard.doc.extend([at] * len(both))
                shard.tf.extend([counts[t] for t in both])
            if len(shard.lengths) >= shard_docs or len(shard.term) > SHARD_POSTINGS:
                shard.ids.append(b.column(0).take(pa.array(some, pa.int64())))
                yield shard.row(id_type)
                shard, some = _Postings(), []
        shard.ids.append(b.column(0).take(pa.array(some, pa.int64())))
    if shard.n_docs:
        yield shard.row(id_type)


class Best:
    """The k best (score, document) so far: highest scores first, equal ones by document, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []
        #: A document below this score can't enter.
        self.least = 1

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, docs = scores[keep], docs[keep]
        self.rows += [(-s, ids[d] is None, 0 if ids[d] is None else ids[d]) for s, d in zip(scores.tolist(), docs.tolist())]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


class Shard:
    """A shard's lists with what each posting adds to a score."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, dfs: np.ndarray, docs: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        wide = object if 50 * int(lengths.max(initial=0)) * n_docs >= 1 << 63 else np.int64
        m = (50 + 50 * lengths.astype(wide) * n_docs // n_terms).astype(np.int64)
        tf = tfs.astype(np.int64)
        self.docs = docs
        self.adds = np.repeat(weights[terms], dfs) * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
        ends = np.cumsum(dfs)
        self.bounds = np.maximum.reduceat(self.adds, ends - dfs) if len(terms) else np.zeros(0, dtype=np.int64)
        self.list_of = {t: i for i, t in enumerate(terms.tolist())}
        # Where each block of documents begins in each list; the last column is where the list ends.
        self.firsts = np.arange(0, len(lengths), BLOCK_DOCS)
        width = len(lengths) + 1
        keys = np.repeat(np.arange(len(terms)), dfs) * width + docs
        edges = np.append(self.firsts, len(lengths))
        self.at = np.searchsorted(keys, np.arange(len(terms))[:, None] * width + edges[None])

    def search(self, query: np.ndarray, best: Best, ids: list) -> None:
        """Offers every document that can be among the best for the query's terms."""
        lists = np.array([self.list_of[t] for t in query.tolist() if t in self.list_of], dtype=np.int64)
        lists = lists[np.argsort(self.bounds[lists], kind="stable")]
        upto = np.cumsum(self.bounds[lists])
        for b, first in enumerate(self.firsts.tolist()):
            essential = int(np.searchsorted(upto, best.least))  # lists before it can't reach the least score together
            if essential == len(lists):
                return
            sums = np.zeros(BLOCK_DOCS, dtype=np.int64)
            for t in lists[essential:].tolist():
                s, e = self.at[t, b], self.at[t, b + 1]
                sums[self.docs[s:e] - first] += self.adds[s:e]
            found = np.flatnonzero(sums)
            scores = sums[found]
            for j in range(essential - 1, -1, -1):
                can = scores + upto[j] >= best.least
                found, scores = found[can], scores[can]
                if not len(found):
                    break
                s, e = self.at[lists[j], b], self.at[lists[j], b + 1]
                docs = self.docs[s:e] - first
                place = np.minimum(np.searchsorted(docs, found), max(0, e - s - 1))
                if e > s:
                    scores = scores + np.where(docs[place] == found, self.adds[s:e][place], 0)
            enter = scores >= best.least
            if enter.any():
                best.offer(scores[enter], found[enter] + first, ids)


def _ranked(docs: DataFrame, items: list[tuple], item_type: T.DataType, k: int, shard_docs: int) -> DataFrame | None:
    """(item_id, rank, id, score) of k documents at most for each item; None if nothing can be found."""
    vocabulary: dict[bytes, int] = {}
    queries = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(words(text))], dtype=np.int32) for _, text in items]
    id_type = docs.schema["id"]
    path = fresh_path(docs.sparkSession, "search-shards")
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type.dataType)), *T.StructType.fromDDL(_INDEX).fields])
    shards = staged(map_batches(docs, lambda batches: _indexed(batches, vocabulary, shard_docs), schema), "search-shards", compression="zstd", path=path)
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not vocabulary:
        return None
    # One row a term of the block of queries.
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect():
        df[r["terms"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def run(batches):
        best, some = [Best(k) for _ in queries], None
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                ids, lengths, terms, dfs = (b.column(i).flatten() for i in range(4))
                some, ids = ids.type, ids.to_pylist()
                doc, tf = (np.frombuffer(b.column(i)[0].as_py(), dtype=np.int32) for i in (4, 5))
                shard = Shard(lengths.to_numpy(zero_copy_only=False), terms.to_numpy(zero_copy_only=False), dfs.to_numpy(zero_copy_only=False), doc, tf, weights, n_docs, n_terms)
                for query, own in zip(queries, best):
                    shard.search(query, own, ids)
        for i, own in enumerate(best):
            if own.rows:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own.rows), pa.int32()), pa.array([None if none else d for _, none, d in own.rows], some), pa.array([-s for s, _, _ in own.rows], pa.int64())], ["item", "id", "score"])

    found = shards.select("ids", "lengths", "terms", "dfs", "docs_of", "tfs").mapInArrow(run, T.StructType([T.StructField("item", T.IntegerType()), id_type, T.StructField("score", T.LongType())]))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    found = found.withColumn("g", F.pmod(F.xxhash64("id", "score"), F.lit(GROUPS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "g").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    # One row an item of the block.
    numbers = docs.sparkSession.createDataFrame([(i, n) for n, (i, _) in enumerate(items)], T.StructType([T.StructField("item_id", item_type), T.StructField("item", T.IntegerType())]))
    out = staged(found.join(F.broadcast(numbers), "item").select("item_id", "rank", "id", "score"), "search-results")
    discard(path)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = TOP, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, id, score): the k documents with the highest scores above 0 for each item, from rank 1; equal scores by ascending id, null last.

    items has item_id and text. Terms are runs of ASCII letters and digits and anything outside ASCII, A-Z in lower case. Null and
    empty texts have none: such items have no rows, such documents are not counted. Repeated terms of an item count once. Rows of items
    that share id and text are one item; of those that share the id alone, each has its own ranks. Repeated rows of docs are
    documents of their own. Without items or documents there are no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    item_type, n = items.schema["item_id"].dataType, max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    found = []
    for block in range(n):
        own = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]
        if own and (ranked := _ranked(rows, own, item_type, k, shard_docs)) is not None:
            found.append(ranked)
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])
    return reduce(DataFrame.unionAll, found or [docs.sparkSession.createDataFrame([], schema)]).withColumnRenamed("id", id_col)


def op13(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nn),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
