"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_run = uuid.uuid4().hex[:12]
_roots: set[str] = set()
#: Where the rows of a frame made by written() lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Where spark.checkpoint.dir points; a local folder only where none is configured and all tasks run on this machine."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/sparkscope"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="sparkscope-")
    return _own


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system, whatever the store."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended, or the store is gone: nothing is lost
        return


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder in this process's part of the shared one, which goes when the process ends."""
    root = f"{shared_folder(spark)}/{_run}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(deleted, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once: all that reads it sees the same rows, also after lost executors. It goes by discard, or when the process ends."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes the rows of a frame that written() made and that nothing will read again."""
    if path := _paths.pop(df, None):
        deleted(df.sparkSession, path)
