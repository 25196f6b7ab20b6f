"""Packing by concatenate and cut.

First pass: each task tokenises its documents and notes, for each, how many tokens its task had before. The table is written,
so the passes agree also when executors are lost. The tokens of each task are summed; prefix sums over these totals, one row a
task, give every document its place in the stream of all tokens. Second pass: fixed windows are cut from the stream; a document
that crosses a boundary gives a record for each side. Only the last sequence can be short. Texts are never shuffled.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, table
from .encode import VOCABULARY, encoder

CONTEXT, END_ID = 1024, 0


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int | None = END_ID, label: str = "tokens") -> DataFrame:
    """A written table (part, before, id, n_tokens, ids): ids are little-endian, of two bytes where the vocabulary allows, with the end id; before counts the tokens that precede in the same part."""

    def run(batches):
        code, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], dtype=code.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in code.encode(b.column(1))]
            n = [len(x) // code.dtype.itemsize for x in ids]
            at = list(accumulate(n, initial=before))
            before = at.pop()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "before", "id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(map_batches(rows, run, f"part int, before long, id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary"), label, compression="zstd")


def part_starts(tokens: DataFrame) -> dict[int, int]:
    """Tokens before each part; one entry a part, of which there are as many as input splits."""
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    return dict(zip(sorted(totals), accumulate((totals[p] for p in sorted(totals)), initial=0)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the piece's ids.

    Null and empty texts are a document of the end id alone. Repeated rows are packed each by itself, null ids like any other;
    an empty table gives no pieces. The stream follows the order of the input's splits.
    """
    tokens = tokenised(docs, id_col, text_col, vocabulary, end_id, "packing")
    starts = part_starts(tokens)

    def run(batches):
        dtype = encoder(vocabulary).dtype
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, before, doc, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                ids, at, start = np.frombuffer(raw, dtype=dtype).astype("<u4"), starts[part] + before, 0
                while start < n:
                    seq, offset = divmod(at + start, context)
                    length = min(n - start, context - offset)
                    piece = ids[start : start + length]
                    for o, v in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, offset, piece.tolist() if with_ids else None)):
                        o.append(v)
                    start += length
            arrays = [pa.array(out[0], b.column(2).type), *(pa.array(o, pa.int64()) for o in out[1:7]), *([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    made = map_batches(tokens, run, f"id {tokens.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return made.withColumnRenamed("id", id_col)


def op2(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
