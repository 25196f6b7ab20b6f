"""Line dedup with two Bloom filters, for hashes seen once and for hashes seen twice.

The first pass turns long lines into hashes, each once a document. A task makes both filters of its own rows and hands them on in
compressed segments; a segment's filters from all tasks meet in one place, where what is in one task's "once" and another's
is seen twice. No line moves. The second pass looks up every line in the "twice" filter, which has no false negatives: a line that
only one document holds is hardly ever a suspect, and only suspects are counted exactly, by their text, with the largest
identifier that holds them. The lines to drop then go back to the documents: as one table that each task reads while it is small, beyond
that by a join in which neither a frequent line nor a repeated document gathers in a task.

The filters have eight bits for each line that the texts could hold at most, up to 2 ** MOST_BITS bits. Beyond that, more lines become
suspects, up to all, and the result stays exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, discard, fresh_path, map_batches, staged, table
from .files import opened
from .hot import joined

#: Code points that a key needs, documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: log2 of a segment's bits, of all bits at least and at most: a task holds both filters of a few segments, or one whole filter of 2 ** MOST_BITS bits (64 MB).
SEGMENT_BITS, LEAST_BITS, MOST_BITS = 20, 20, 29
#: Bits a line sets.
PROBES = 4
#: Hashes that a task holds before it hands on its filters.
MOST_HASHES = 4_000_000
#: Bytes of keys to drop, with KEY_BYTES more for each, that a task reads as one table.
SMALL, KEY_BYTES = 48 << 20, 200

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = " \t\n\x0b\x0c\r"


def key_of(line: str, least: int = LEAST_CHARS) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; None if it is shorter than `least`."""
    line = line.strip(_SPACE)
    return line.encode().translate(_LOWER) if len(line) >= least else None


def _keys(text: str | None, least: int) -> set[bytes]:
    return {k for x in (text or "").split("\n") if len(x) >= least and (k := key_of(x, least)) is not None}


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, PROBES bits within it) of each hash. The lowest bits choose the segment, the others its bits."""
    segment = (h & np.uint64((1 << (bits - SEGMENT_BITS)) - 1)).astype(np.int64)
    a, b = h >> np.uint64(12), (h >> np.uint64(32)) | np.uint64(1)
    return segment, ((a[:, None] + np.arange(PROBES, dtype=np.uint64)[None] * b[:, None]) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _filled(bits_of: np.ndarray) -> bytes:
    bits = np.zeros(1 << SEGMENT_BITS, dtype=bool)
    bits[bits_of.ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


_FILTERS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _filters(hashes: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Both filters of some hashes, a row a segment."""
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    segment, place = positions(h, bits)
    order = np.argsort(segment, kind="stable")
    ends = np.flatnonzero(np.diff(segment[order], append=-1)) + 1
    for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
        own = order[s:e]
        yield batch(_FILTERS, [int(segment[own[0]])], [zlib.compress(_filled(place[own]), 1)], [zlib.compress(_filled(place[own[n[own] > 1]]), 1)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a segment of the rows that a task gets, all rows of its segments."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for b in batches:
        for s, x, y in zip(*(c.to_pylist() for c in b.columns)):
            x, y = (np.frombuffer(zlib.decompress(z), dtype=np.uint64) for z in (x, y))
            if s in once:
                twice[s] |= y | (once[s] & x)
                once[s] |= x
            else:
                once[s], twice[s] = x.copy(), y.copy()
    for s in once:
        yield batch(_FILTERS, [s], [b""], [zlib.compress(twice[s].tobytes(), 1)])


def twice_filter(rows: DataFrame, bits: int, least: int, path: str) -> None:
    """Writes the segments of the filter of hashes that two rows or more hold."""

    def run(batches):
        hashes, held = [], 0
        for b in batches:
            for text in b.column(1).to_pylist():
                if own := [xxhash.xxh3_64_intdigest(k) for k in _keys(text, least)]:
                    hashes.append(np.array(own, dtype=np.uint64))
                    held += len(own)
            if held > MOST_HASHES:
                yield from _filters(hashes, bits)
                hashes, held = [], 0
        if hashes:
            yield from _filters(hashes, bits)

    schema = "segment int, once binary, twice binary"
    segments = 1 << (bits - SEGMENT_BITS)
    map_batches(rows, run, schema).repartition(max(1, segments // 8), "segment").mapInArrow(_merged, schema).write.parquet(path)


_last: tuple[str, object] | None = None


def _kept(path: str, load):
    """What load makes of the table at path; a worker keeps the one it used last."""
    global _last
    if _last is None or _last[0] != path:
        _last = None
        store, inner = opened(path)
        _last = path, load(dataset.dataset(inner, filesystem=store, format="parquet"))
    return _last[1]


def _suspect(path: str, bits: int):
    """A test of hashes against the filter at path."""

    def load(found):
        bitmap = np.zeros((1 << (bits - SEGMENT_BITS), (1 << SEGMENT_BITS) // 8), dtype=np.uint8)
        for b in found.to_batches(columns=["segment", "twice"], batch_size=64):
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bitmap[s] = np.frombuffer(zlib.decompress(x), dtype=np.uint8)
        return bitmap

    bitmap = _kept(path, load)

    def ask(h: np.ndarray) -> np.ndarray:
        segment, place = positions(h, bits)
        return ((bitmap[segment[:, None], place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)

    return ask


def suspects(rows: DataFrame, path: str, bits: int, least: int) -> DataFrame:
    """(id, mark, key): each key of a row once if the filter at path has its hash."""
    schema = T.StructType([rows.schema["id"], T.StructField("mark", T.LongType()), T.StructField("key", T.BinaryType())])

    def run(batches):
        ask = _suspect(path, bits)
        for b in batches:
            at, keys = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                own = _keys(text, least)
                keys += own
                at += [i] * len(own)
            if keys:
                ok = np.flatnonzero(ask(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)))
                at = pa.array(np.array(at)[ok])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([keys[i] for i in ok], pa.binary())], ["id", "mark", "key"])

    return map_batches(rows.select("id", "text", "mark"), run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS, small: int = SMALL, carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: id, a struct `carried` of the columns in carry if any, n_lines, n_dropped, and kept, its text without dropped lines.

    A line's key is the line without white space at its ends, A-Z in lower case. Lines whose key has at least least_chars code
    points and is held by at least least_docs rows go, but for those of rows with the largest id that holds it; null ids
    are smaller than all others, so if no holder has an id, all keep it. Rows that repeat an id count each as a document, and share its fate. A null
    text is an empty line, which is never dropped; a text all of whose lines go is empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    carried = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("mark"), *carried)
    most = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // least_chars
    bits = min(max(LEAST_BITS, (8 * most).bit_length()), most_bits)
    filters, found = fresh_path(spark, "line-filters"), fresh_path(spark, "line-suspects")
    twice_filter(rows, bits, least_chars, filters)
    if most:
        lines = staged(suspects(rows, filters, bits, least_chars), "line-suspects", path=found)
    else:
        lines = spark.createDataFrame([], T.StructType([rows.schema["id"], T.StructField("mark", T.LongType()), T.StructField("key", T.BinaryType())]))
    path = fresh_path(spark, "dropped-lines")
    dropped = staged(lines.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs), "dropped-lines", path=path)
    discard(filters)
    n, size = dropped.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    if KEY_BYTES * n + (size or 0) <= small:
        names, extra, pairs = ["id", "text"], [], None
    else:
        # The keys that go from each text; a text's own lines bound its set.
        pairs = joined(lines, dropped, "key", "n").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "mark").agg(F.collect_set("key").alias("drop"))
        pairs = pairs.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "drop")
        rows = rows.join(pairs, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
        names, extra = ["id", "text", "drop"], ["drop"]

    def run(batches):
        last = _kept(path, lambda t: dict(zip(*(c.to_pylist() for c in t.to_table(columns=["key", "last"]).columns)))) if not extra and n else {}
        for b in batches:
            out: list[list] = [[], [], []]
            gone = b.column(2).to_pylist() if extra else [None] * b.num_rows
            for own, text, drop in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), gone):
                drop = set(drop or ())
                kept = parts = (text or "").split("\n")
                if drop or last:
                    kept = [x for x in parts if len(x) < least_chars or (k := key_of(x, least_chars)) is None or not (k in drop if extra else k in last and last[k] != own)]
                for o, v in zip(out, (len(parts), len(parts) - len(kept), "\n".join(kept))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, (pa.int64(), pa.int64(), pa.string())), *b.columns[len(names) :]], ["id", "n_lines", "n_dropped", "kept", *b.schema.names[len(names) :]])

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_lines long, n_dropped long, kept string").fields, *([rows.schema["carried"]] if carry else [])])
    return map_batches(rows.select(*names, *(["carried"] if carry else [])), run, schema).withColumnRenamed("id", id_col)


def op12(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND doc_id <> last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.k = g.k GROUP BY doc_id
"""
