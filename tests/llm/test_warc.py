import hashlib
import os

import pytest

from sparkscope.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, to int"


def brute(pages):
    last = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, u, h in pages:
        p = (h or "").encode()
        to = last.get(p) if i is not None else None
        to = to if to is not None and i < to else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def case():
    big, edge = "é<p>\r\n\r\n" * 300, "x" * 999
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, "http://a/9", big), (3, "http://a/3\r\nX: y z", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (None, None, None),
        (7, "u", edge), (8, "u", edge), (10, "u", edge + "x"), (11, "u", edge + "x"), (12, "u", "long " * 300_000), (12, "u", "other"),
    ]


def test_round_trip_of_records_and_rolled_files(spark, tmp_path):
    rows = case()
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(df, folder, roll_bytes=2000, parts=3)
    files = sorted(r["file"] for r in manifest.collect())
    assert len(files) > 3 and sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")) == files and not [f for f in os.listdir(tmp_path / "a") if f.startswith("_temp")]
    got = warc.read_archives(manifest, folder)
    assert sorted((tuple(r) for r in got.drop("url").collect()), key=str) == brute(rows)
    assert {r["url"] for r in got.where("page_id = 3").collect()} == {"http://a/3%0D%0AX:%20y%20z"}
    again = f"file://{tmp_path}/b"
    assert sorted(map(tuple, warc.write_archives(df.repartition(5), again, roll_bytes=2000, parts=3).collect())) == sorted(map(tuple, manifest.collect()))


def test_files_depend_on_the_pages_alone(spark, tmp_path):
    pages = spark.range(10_000).selectExpr("(id * 7919) % 9000 as page_id", "concat('u', id % 50) as url", "repeat(concat('<p>', id % 4000), 40) as html", "id as digest")
    hot = spark.range(3000).selectExpr("4500L as page_id", "'u' as url", "repeat(concat('hot', id % 1000), 300) as html", "id as digest")
    found = []
    for k, df in enumerate((pages.unionAll(hot).repartition(3), pages.unionAll(hot).orderBy(warc.F.desc("page_id")).coalesce(2), hot.unionAll(pages).repartition(17))):
        spark.conf.set("spark.sql.adaptive.enabled", str(k != 1).lower())
        manifest = warc.write_archives(df, f"file://{tmp_path}/{k}", roll_bytes=100_000, parts=5)
        found.append(sorted(map(tuple, manifest.collect())))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {*range(5)} and sum(r[3] for r in found[0]) == 13_000
    by_part = [sum(r[3] for r in found[0] if r[0] == p) for p in range(5)]
    assert max(by_part) < 2 * 13_000 / 5  # one page_id with a quarter of all rows doesn't fill a range


def test_pages_without_ids_are_spread_over_ranges(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then id end as page_id", "concat('u', id % 5000) as url", "repeat('empty', cast(id % 2 as int)) as html", "id as digest")
    folder = f"file://{tmp_path}/n"
    manifest = warc.write_archives(rows.repartition(5), folder, parts=6)
    by_part = {}
    for r in manifest.collect():
        by_part[r["part"]] = by_part.get(r["part"], 0) + r["records"]
    assert len(by_part) == 6 and max(by_part.values()) < 2 * 20_000 / 6 and sum(by_part.values()) == 20_000
    assert warc.read_archives(manifest, folder).where("page_id is null").count() == rows.where("page_id is null").count()
    again = warc.write_archives(rows.orderBy("url").coalesce(2), f"file://{tmp_path}/m", parts=6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_empty_table_and_damaged_archives(spark, tmp_path):
    df = spark.createDataFrame([(*x, "d", 1) for x in case()], SCHEMA)
    folder = f"file://{tmp_path}/none"
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).collect() == []
    raw = warc.member(warc.record(1, "u", b"payload", None))
    assert [h["WARC-Type"] for h, _ in warc.records(raw + raw)] == ["response", "response"]
    with pytest.raises((ValueError, Exception)):
        list(warc.records(raw[:-9]))


def test_query_matches_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.op8(spark, sf_dir).collect()), key=str) == brute(pages)
