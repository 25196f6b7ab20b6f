"""Deterministic WARC archives, written in shards and read back.

Records are range-sorted by page_id and a hash of the payload and its address, pages without an id by the hash alone. The ranges
follow from the pages alone: their number from the bytes of all payloads, their bounds from the pages with small hashes. So the same pages give the same files, whatever
the partitions, cores or order of the input. Each record is a gzip member of its own; a file is rolled when its compressed size
reaches ROLL_BYTES. Headers and digests are made anew from the payload. A file gets its name only when complete, and a written
manifest lists the files with their sizes and digests.

Of pages with equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is a response and the others
revisit it. Only page_id, digest and length are grouped for that, pre-aggregated before the shuffle; the decisions are
merged into the range sort as small rows, so payloads are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, staged, table
from .files import committed, made_dir, read_bytes

ROLL_BYTES = 64 << 20
#: Payload bytes of a range; of small tables there are up to FEW_RANGES smaller ones, for work at the same time. Pages whose keys give a range's bounds.
RANGE_BYTES, SMALL_RANGE, FEW_RANGES, SAMPLED = 256 << 20, 4 << 20, 64, 32
LEAST_REVISIT = 1000
#: Records have a fixed date, so that archives depend on their pages alone.
RECORD_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: URLs


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}')}>"


def _line(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed record; a revisit keeps the payload's length and digest in its headers and the payload out."""
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    body = b"software: warc writer\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>", f"WARC-Date: {RECORD_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member, checked against its length and block digest."""
    at = 0
    while at < len(raw):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(raw):
                raise ValueError("the archive is cut short")
            parts.append(z.decompress(raw[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(raw)) - len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError("a record's block digest is wrong")
        yield headers, block


def _parts(size: int) -> int:
    """Ranges for that many bytes."""
    return max(1, ceil(size / RANGE_BYTES), min(FEW_RANGES, ceil(size / SMALL_RANGE)))


def _bounds(keys: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """Keys (known, page_id, h) that part n ranges: quantiles of about SAMPLED * n keys, those with small hashes. They depend on the rows alone.

    The keys are range-sorted and ranked where they are; only the bounds come to the driver, one for RANGE_BYTES of payload.
    """
    total = keys.count()
    if n < 2 or not total:
        return []
    share = min(1.0, SAMPLED * n / total)
    key = ["known", "page_id", "h"]
    chosen = keys.where(F.pmod(F.xxhash64(*key, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    ranges = staged(chosen.repartitionByRange(max(1, n // FEW_RANGES), *key).withColumn("range", F.spark_partition_id()), "warc-keys")
    sizes = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row for FEW_RANGES bounds
    m, starts = sum(sizes.values()), {}
    for r in sorted(sizes):
        starts[r] = sum(sizes[k] for k in starts)
    if not m:
        return []
    before = F.broadcast(keys.sparkSession.createDataFrame([*starts.items()], "range int, before long"))
    ranked = ranges.join(before, "range").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1)
    # The rank is that of the i-th of n quantiles.
    i = F.floor((F.col("r") * n + m - 1) / F.lit(m)).cast("long")
    found = ranked.withColumn("i", i).where((F.floor(F.col("i") * m / F.lit(n)).cast("long") == F.col("r")) & F.col("i").between(1, n - 1)).select(*key).collect()
    return sorted({tuple(r) for r in found})


def _ranges(bounds: list[tuple[bool, int, int]]):
    """A column function of (page_id, h): the number of the range, null page_ids first; only these two columns go to Python."""
    nameless = np.array([b[2] for b in bounds if not b[0]], dtype=np.int64)
    named = [b[1:] for b in bounds if b[0]]
    ids = np.array([b[0] for b in named], dtype=np.int64)

    @F.pandas_udf("int")
    def part(page_id: pd.Series, h: pd.Series) -> pd.Series:
        known = page_id.notna().to_numpy()
        p = page_id.fillna(0).to_numpy(dtype=np.int64)
        at, to = np.searchsorted(ids, p, "left"), np.searchsorted(ids, p, "right")
        for i in np.flatnonzero(at < to):  # pages that share their page_id with a bound
            at[i] = bisect_left(named, (int(p[i]), int(h.iloc[i])), int(at[i]), int(to[i]))
        return pd.Series(np.where(known, len(nameless) + at, np.searchsorted(nameless, h.to_numpy(dtype=np.int64), "left")).astype(np.int32))

    return part


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT, parts: int | None = None) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) and returns the written manifest (part, seq, file, records, bytes, sha1).

    Null html is an empty payload, a null url an empty target. Rows that repeat a page_id each get a record; of equal payloads those
    with the largest page_id are responses; rows with a null page_id are responses. An empty table gives no archives.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.xxhash64(html, F.col("url").cast("string")).alias("h"))
    digest = F.when((F.octet_length("html") >= least_revisit) & F.col("page_id").isNotNull(), F.sha1(F.encode("html", "utf-8")))
    keys = staged(pages.select("page_id", "h", F.octet_length("html").cast("long").alias("n"), digest.alias("digest")), "digests")
    n = parts or _parts(keys.agg(F.sum("n")).first()[0] or 0)
    bounds = _bounds(keys.select(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "h"), n)
    digests = keys.where("digest is not null").select("page_id", "h", "digest")
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("to"), F.min("page_id").alias("from")).where("`from` < `to`")
    revisits = digests.join(shared, "digest").where("page_id < `to`").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "h", "to", "digest").distinct()
    rows = pages.select("*", F.lit(None).cast("long").alias("to"), F.lit(None).cast("string").alias("digest")).unionAll(revisits)
    ranged = rows.withColumn("part", _ranges(bounds)("page_id", "h")).repartitionById(len(bounds) + 1, F.col("part"))
    ordered = ranged.sortWithinPartitions("part", "page_id", "h", F.col("html").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest")
    made_dir(folder)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def compressed(rows):
        page, revisit = object(), {}
        for page_id, url, html, h, to, digest, _ in rows:
            if (page_id, h) != page:
                page, revisit = (page_id, h), {}
            if html is None:  # a decision; it precedes the page's own rows
                revisit[digest] = to
                continue
            payload = html.encode()
            yield member(record(page_id, url, payload, revisit.get(hashlib.sha1(payload).hexdigest()) if revisit else None))

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for part, of in groupby(rows, key=lambda r: r[-1]):
            todo, seq = compressed(of), 0
            data = next(todo, None)
            while data is not None:
                name, count, sha = f"pages-{part:06d}-{seq:05d}.warc.gz", 0, hashlib.sha1()
                with committed(folder, name) as out:
                    first = member(info_record(name))
                    out.write(first)
                    sha.update(first)
                    size = len(first)
                    while data is not None and (not count or size + len(data) <= roll_bytes):
                        out.write(data)
                        sha.update(data)
                        size, count, data = size + len(data), count + 1, next(todo, None)
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "records": count, "bytes": size, "sha1": sha.hexdigest()}], schema=schema)
                seq += 1

    made = map_batches(ordered, run, "part int, seq int, file string, records long, bytes long, sha1 string")
    made.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/_manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every page record in the manifest's files, all digests checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for b in batches:
            for name, sha in zip(*(c.to_pylist() for c in b.columns)):
                raw = read_bytes(folder, name)
                if hashlib.sha1(raw).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest lists")
                rows = []
                for h, block in records(raw):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, digest = int(head.rpartition(b"Content-Length: ")[2]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {name} is not what its headers say")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append({"page_id": number("X-Page-ID"), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page")})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("file", "sha1")
    return map_batches(files.repartition(max(1, manifest.count()), "file"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder).drop("url")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS last_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM l
"""
