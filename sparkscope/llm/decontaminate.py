"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of every text.

The automaton's symbols are words: A-Z in lower case, words of ASCII letters, digits and anything outside ASCII. It holds
every window of 13 consecutive words of an item, or all of a shorter item. Items lie in the shared folder in parts of about
MOST_WORDS words, and a task reads the part it needs. One part is the usual case: one automaton, one scan. With more, a task
puts its rows into a file beside the parts and runs over them once a part, one automaton after the other, in the same pass over
the table and without a shuffle: memory is that of one automaton, however large the benchmark, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyarrow import dataset
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, map_batches, table
from .files import opened

WINDOW = 13
#: Words of items in one automaton, about 150 MB in a task.
MOST_WORDS = 500_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i in _KEEP else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Scanner:
    """The automaton of some (item_id, text) pairs."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in words(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows[ids[i : i + window]].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items_of in windows.items():
            self.automaton.add_word(key, (len(key), tuple(items_of)))
        if windows:
            self.automaton.make_automaton()
        self.some = bool(windows)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(runs of hit words as (start, end), items with an occurring window)."""
        runs: list[tuple[int, int]] = []
        items: set = set()
        if not self.some or not found:
            return runs, items
        get = self.symbols.get
        for end, (n, of) in self.automaton.iter(tuple([get(w, 0) for w in found])):
            items.update(of)
            s, e = end - n + 1, end + 1
            while runs and s <= runs[-1][1]:  # a longer window may reach back over several runs
                a, b = runs.pop()
                s, e = min(a, s), max(b, e)
            runs.append((s, e))
        return runs, items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_last: tuple[tuple[str, int], Scanner] | None = None


def _scanner(folder: str, part: int, window: int) -> Scanner:
    """The automaton of a part; a worker keeps the one it used last."""
    global _last
    if _last is None or _last[0] != (folder, part):
        _last = None
        store, path = opened(f"{folder}/part={part}")
        some = dataset.dataset(path, filesystem=store, format="parquet").to_table().to_pylist() if store.get_file_info(path).type == FileType.Directory else []
        _last = (folder, part), Scanner([(r["item_id"], r["text"]) for r in some], window)
    return _last[1]


def _found(batches: Iterator[pa.RecordBatch], folder: str, parts: int, window: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches, with (number of words, runs, items) of each row over all parts. With more parts than one the rows wait in the shared folder."""
    store, path = opened(f"{folder}/_rows-{uuid.uuid4().hex}")
    known: dict[int, tuple[list, set]] = {}
    try:
        for part in range(parts):
            scanner, row, last, file, writer = _scanner(folder, part, window), 0, part == parts - 1, None, None
            if part:
                file = store.open_input_stream(path)
            for b in pa.ipc.open_stream(file) if part else batches:
                if not part and not last:
                    file = file or store.open_output_stream(path)
                    writer = writer or pa.ipc.new_stream(file, b.schema)
                    writer.write_batch(b)
                out = []
                for text in b.column(1).to_pylist():
                    found = words(text)
                    runs, hit = scanner.scan(found)
                    if before := known.pop(row, None):
                        runs, hit = _merged([*before[0], *runs]), before[1] | hit
                    if last:
                        out.append((len(found), runs, hit))
                    elif runs:
                        known[row] = runs, hit
                    row += 1
                if last:
                    yield b, out
            if writer:
                writer.close()
            if file:
                file.close()
            elif not last:
                return  # a task without rows
    finally:
        if store.get_file_info(path).type == FileType.File:
            store.delete_file(path)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS, carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: id, a struct `carried` of the columns in carry if any, n_words, n_hit, n_items, items_sha256, contaminated, and spans of the hit passages in code points of the original text.

    benchmark has item_id and text. Null and empty texts, of documents and of items, have no words and hit nothing; an item
    whose id is null marks words but counts in no n_items; items that repeat an id count once. A document is contaminated
    if it has hits and at least a twentieth of its words are hit. Without items nothing is hit; without documents there are no rows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, folder = max(1, math.ceil(size / (7 * most_words))), fresh_path(docs.sparkSession, "benchmark")
    items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).write.partitionBy("part").parquet(folder)
    carried = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carried)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def run(batches):
        for b, found in _found(batches, folder, parts, window):
            out: list[list] = [[] for _ in names]
            for text, (n, runs, hit) in zip(b.column(1).to_pylist(), found):
                ids, n_hit, spans = sorted(x for x in hit if x is not None), sum(e - s for s, e in runs), []
                if runs:
                    places = [m.span() for m in _WORD.finditer(text)]
                    spans = [{"start": places[s][0], "end": places[e - 1][1]} for s, e in runs]
                for o, v in zip(out, (n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, spans)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, types), *b.columns[2:]], ["id", *names, *b.schema.names[2:]])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(RESULT).fields, *([rows.schema["carried"]] if carry else [])])
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with docs' columns, in one pass without a shuffle. Rows with a null doc_id are judged by their text as well."""
    return decontaminate(docs, benchmark, carry=docs.columns).where(~F.col("contaminated")).select("carried.*")


def op3(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS l, array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, p, l, array_to_string(ws[p : p + l - 1], ' ') AS win
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, lens WHERE len(ws) >= l)
), m AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
