"""What the operators share: inputs, staged tables, row batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import opened

#: Rows that an operator's Python code takes at a time; texts may be long, so they are few.
BATCH_ROWS = 512

_own_dir: str | None = None
_RUN = uuid.uuid4().hex[:12]
_roots: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and all tasks run on this machine."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="sparkscope-")
    return _own_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this process's part of the shared folder, which goes when the process ends."""
    root = f"{shared_dir(spark)}/sparkscope/{_RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(discard, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def discard(path: str) -> None:
    """Deletes a folder of intermediate data that nothing will read again."""
    with contextlib.suppress(OSError, ValueError):
        store, inner = opened(path)
        store.delete_dir(inner)


def staged(df: DataFrame, label: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows doesn't compute it again, also after lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over slices of at most BATCH_ROWS rows: what f makes of a slice is bounded, whatever the session's settings."""
    return df.mapInArrow(lambda batches: f(_slices(batches)), schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the identifier's text, modulo the folds; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
