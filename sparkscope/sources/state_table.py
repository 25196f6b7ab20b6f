"""A state table in a folder: rows by key, merged in hash buckets, with a snapshot for every change.

A version is a manifest that names, for each bucket, the folder of its rows. A merge reads and rewrites only the buckets that its
changes fall into; the new manifest names the old folders of all others. It appears under its final name by one rename that fails
if another writer was first, so a reader sees a whole version or the one before, and a lost executor or driver leaves only folders
that nobody names. Files go through Spark's own file system, whatever the store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


GONE, BUCKET = "_gone", "_bucket"


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    #: Folder by bucket; buckets without rows have none.
    folders: dict[int, str]


class StateTable:
    """keys name the columns that are unique; buckets is fixed when the folder is first written."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def _place(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    @property
    def _store(self):
        return self._place().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        store, place = self._store, self._place("versions")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(place) if f.getPath().getName().isdigit()) if store.exists(place) else []

    def version(self, number: int | None = None) -> Version | None:
        """The version of that number, the last without one; None before the first write. A ValueError if there is no such number."""
        known = self.versions()
        if number is not None and number not in known:
            raise ValueError(f"no version {number}")
        if not known:
            return None
        number = known[-1] if number is None else number
        text = self.spark.read.text(f"{self.folder}/versions/{number:012d}", wholetext=True).first()[0]
        body = json.loads(text)
        if body["keys"] != self.keys or body["buckets"] != self.buckets:
            raise ValueError(f"the table has keys {body['keys']} in {body['buckets']} buckets")
        return Version(number, T.StructType.fromJson(body["schema"]), {int(k): v for k, v in body["folders"].items()})

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        v = self.version(number)
        if v is None:
            raise ValueError("nothing has been written")
        return self._rows(v, [*v.folders]).where(~F.col(GONE)).drop(GONE)

    def _rows(self, v: Version, buckets: list[int]) -> DataFrame:
        """Rows of some buckets, with _gone for keys that have been deleted: a late repetition of what came before must not bring them back."""
        paths, schema = [f"{self.folder}/rows/{v.folders[b]}" for b in buckets if b in v.folders], T.StructType([*v.schema, T.StructField(GONE, T.BooleanType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _same(self, of: str) -> Column:
        """Whether the keys are those of a frame whose keys are named of0, of1, ..."""
        return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"{of}{i}")) for i, k in enumerate(self.keys)])

    def _keys_as(self, of: str) -> list[Column]:
        return [F.col(f"`{k}`").alias(f"{of}{i}") for i, k in enumerate(self.keys)]

    def _latest(self, rows: DataFrame, order: str) -> DataFrame:
        """One row a key, with its deletion if that came last. Rows are combined before they are shuffled."""
        every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        at = F.struct(F.col(f"`{order}`"), F.col(GONE), F.to_json(every))
        return rows.groupBy(*self._keys_as("k")).agg(F.max_by(every, at).alias("last")).select("last.*")

    def _filled(self, there: DataFrame, marked: DataFrame, order: str) -> DataFrame:
        """One row a key, in which each column has the last value that a change names after the key's last deletion."""
        o, columns = F.col(f"`{order}`"), [c for c in there.columns if c not in self.keys]
        base = there.select(*self._keys_as("b"), o.alias("base_at"), F.lit(True).alias("is_there"))
        fresh = marked.join(base, self._same("b"), "left").where(F.col("is_there").isNull() | (o > F.col("base_at"))).select(*there.columns)
        ends = fresh.where(GONE).groupBy(*self._keys_as("e")).agg(F.max(o).alias("end_at"))
        alive = there.where(~F.col(GONE)).unionByName(fresh.where(~F.col(GONE))).join(ends, self._same("e"), "left")
        alive = alive.where(F.col("end_at").isNull() | (o > F.col("end_at")))
        at = F.struct(o, F.to_json(F.struct(*[F.col(f"`{c}`") for c in there.columns])))
        named = alive.groupBy(*self._keys_as("k")).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), at)).alias(c) for c in columns])
        kept = named.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)], *[F.col(f"`{c}`") for c in columns])
        dead = there.where(GONE).unionByName(fresh.where(GONE))
        return self._latest(kept.unionByName(dead), order)

    def merge(self, changes: DataFrame, order: str, delete: str | None = None, partial: bool = False) -> int:
        """Puts changes into the table and gives the number of the version that holds them.

        The change with the greatest order of a key wins over earlier ones and over the row that is there; one that is repeated, or
        comes after a later one, changes nothing, also after a deletion. Equal orders are settled by all columns. With partial a
        null leaves a column as it was. delete names a boolean column of changes: where it is true the key goes.
        Null keys are keys. Rows without order are older than all others. A Conflict says that another writer was first; merge again then.
        """
        old = self.version()
        if old is None:
            old = Version(0, T.StructType([f for f in changes.schema if f.name != delete]), {})
        columns = [F.col(f"`{c}`") for c in old.schema.names]
        gone = F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False)
        marked = changes.select(*columns, gone.alias(GONE))
        touched = sorted(r[0] for r in marked.select(self._bucket().alias("b")).distinct().collect())  # at most one row a bucket
        if not touched and old.number:
            return old.number
        there = self._rows(old, touched)
        merged = self._filled(there, marked, order) if partial else self._latest(marked.unionByName(there), order)
        made = f"{old.number + 1:012d}-{uuid.uuid4().hex[:12]}"
        merged.select(*columns, GONE, self._bucket().alias(BUCKET)).repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/rows/{made}")
        store = self._store
        full = {int(f.getPath().getName().split("=")[1]) for f in store.listStatus(self._place("rows", made)) if f.getPath().getName().startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in old.folders.items() if b not in touched} | {b: f"{made}/{BUCKET}={b}" for b in full}
        return self._commit(Version(old.number + 1, old.schema, folders))

    def _commit(self, v: Version) -> int:
        store, name = self._store, f"{v.number:012d}"
        store.mkdirs(self._place("versions"))
        temporary, final = self._place("versions", f"_{name}-{uuid.uuid4().hex[:12]}"), self._place("versions", name)
        out = store.create(temporary, False)
        out.write(bytearray(json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": v.schema.jsonValue(), "folders": v.folders}).encode()))
        out.close()
        if store.exists(final) or not store.rename(temporary, final):
            store.delete(temporary, False)
            raise Conflict(f"version {v.number} is there already")
        return v.number

    def touched(self, number: int) -> list[int]:
        """Buckets that a version rewrote or emptied."""
        new = self.version(number).folders
        old = self.version(number - 1).folders if number - 1 in self.versions() else {}
        return sorted(b for b in {*new, *old} if new.get(b) != old.get(b))

    def forget(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep` and the folders of rows that none of these names; the number of folders deleted. No writer may be at work."""
        known, store = self.versions(), self._store
        kept = known[-keep:] if keep > 0 else []
        used = {f for n in kept for f in self.version(n).folders.values()}
        for n in known[: len(known) - len(kept)]:
            store.delete(self._place("versions", f"{n:012d}"), False)
        gone = 0
        for made in store.listStatus(self._place("rows")) if store.exists(self._place("rows")) else []:
            for f in store.listStatus(made.getPath()):
                name = f"{made.getPath().getName()}/{f.getPath().getName()}"
                if f.isDirectory() and name not in used:
                    gone += bool(store.delete(f.getPath(), True))
        return gone
