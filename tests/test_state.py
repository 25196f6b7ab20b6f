import datetime
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkscope.functions import calc as C
from sparkscope.operators import patterns as L
from sparkscope.operators import profile as P
from sparkscope.operators.tablecalc import row_numbers
from sparkscope.operators.worksheet import grid, role_of, visual_of
from sparkscope.queries.sheets import book
from sparkscope.sources import sinks as K
from sparkscope.sources import tables as S
from sparkscope.sources import workbook as B


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_numbers_keep_every_row_with_further_columns(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(30_000).select(F.when(F.col("id") % 1000 != 0, F.xxhash64("id") % 5000).alias("k"), "id", F.repeat(F.lit("x"), 50).alias("_part")).repartition(9)
        rows = row_numbers(df, ["k", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted(((r["k"] is not None, r["k"] or 0, r["id"]) for r in rows))
    assert len(rows) == 30_000 and rows[0]["_part"] == "x" * 50
    assert [(r["k"] is not None, r["k"] or 0, r["id"]) for r in sorted(rows, key=lambda r: r["row_index"])] == want
    assert sorted(r["row_index"] for r in rows) == [*range(1, 30_001)]
    assert row_numbers(df.limit(0), ["k"]).collect() == []


def test_date_differences_count_boundaries(spark):
    t = lambda *x: datetime.datetime(*x)
    df = spark.createDataFrame([(t(2023, 12, 31, 23, 59, 59), t(2024, 1, 1, 0, 0, 1))], "a timestamp, b timestamp")
    got = df.select(*[C.datediff(p, F.col("a"), F.col("b")).alias(p) for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")]).first()
    assert [*got] == [1, 1, 1, 1, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        C.datediff("century", F.col("a"), F.col("b"))


def test_profiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, "", float("nan")), (2, None, "5", 1.5), (3, None, "7", None)], "a int, b string, c string, d double")
    p = {r["column"]: r for r in P.column_profiles(df, "t").collect()}
    assert (p["a"]["is_sequential"], p["a"]["data_type"], p["a"]["median"]) == (True, "int", 2.0)
    assert (p["b"]["data_type"], p["b"]["null_percent"], p["b"]["unique_count"]) == ("unknown", 100.0, 0)
    assert (p["c"]["empty_count"], p["c"]["data_type"]) == (1, "string")
    assert {r["column"]: r["row_count"] for r in P.column_profiles(df.limit(0), "t").collect()} == dict.fromkeys("abcd", 0)


def test_stored_results_uploads_and_reports(spark, tmp_path):
    store = K.ResultStore(spark, f"file://{tmp_path}/results")
    df = spark.createDataFrame([(1, "ds.orders"), (2, "ds.orders.lines")], "id long, name string")
    assert not store.has("j1")
    store.save("j1", df)
    assert store.has("j1") and store.get("j1").count() == 2 and [*store.all()] == ["j1"]
    store.delete("j1")
    assert not store.has("j1")
    paths = K.workbook_report({"names": df}, {"ds.orders": "Orders", "ds.orders.lines": "Lines"}, f"file://{tmp_path}/report")
    assert sorted(r["name"] for r in spark.read.csv(paths[0], header=True).collect()) == ["Lines", "Orders"]
    for name, text in (("a.csv", "x"), ("b.exe", "x"), ("c.csv", "")):
        (tmp_path / name).write_text(text)
    found = {os.path.basename(r["path"]): r["problem"] for r in S.checked_uploads(spark, [f"file://{tmp_path}/{n}" for n in ("a.csv", "b.exe", "c.csv")]).collect()}
    assert found == {"a.csv": None, "b.exe": "unknown kind of file", "c.csv": "file is empty"}
    K.append_state(df, f"file://{tmp_path}/state")
    K.append_state(df, f"file://{tmp_path}/state")
    assert spark.read.parquet(f"file://{tmp_path}/state").count() == 4


def test_patterns_of_files(spark, tmp_path):
    rows = [{"id": "p1", "tags": ["sum", "lod"], "difficulty": "Easy", "formula": "SUM([x])", "target": "sum(x)", "notes": "plain"}, {"id": "p2", "tags": ["rank"], "difficulty": "Hard", "formula": "RANK(SUM([x]))", "target": "rank", "notes": None}]
    (tmp_path / "patterns.json").write_text(json.dumps(rows))
    p = L.read_patterns(spark, f"file://{tmp_path}/patterns.json")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(L.by_tags(p, ["rank", "lod"])) == ["p1", "p2"] and ids(L.by_tags(p, ["sum", "lod"], all_of=True)) == ["p1"] and ids(L.by_difficulty(p, "HARD")) == ["p2"] and ids(L.search(p, "PLAIN")) == ["p1"]
    assert [r["id"] for r in L.suggestions(p, "SUM([y])").collect()][0] == "p1" and L.prompt(p).count("\n") == 1


def test_everything_in_a_workbook(spark, tmp_path):
    b = book(spark)
    rows = lambda k: [tuple(r) for r in b[k].collect()]
    assert rows("hierarchies") == [("Market", ["c_mktsegment", "o_orderstatus"])] and rows("groups") == [("Open", "o_orderstatus", ["O", "P"])]
    assert rows("bins") == [("o_totalprice", 50.0, "element"), ("o_totalprice", 100.0, "calculation")] and rows("palettes") == [("o_orderstatus", "F", "#ff0000"), ("o_orderstatus", "O", "#00ff00")]
    assert rows("blends") == [("shop", "c_mktsegment", "targets", "segment")] and rows("actions") == [("To detail", "filter", "Sales", ["Trend"], ["o_orderstatus"], None)]
    assert rows("tooltips") == [("Sales", "Total of the segment")] and rows("formats") == [("Sales", "o_totalprice", "#,##0")] and rows("highlights") == [("Sales", ["o_orderstatus"])]
    assert {(r[3], r[4], r[7]) for r in rows("zones")} == {("desktop", "Sales", 640), ("desktop", "Trend", 640), ("phone", "Sales", 360)}
    with zipfile.ZipFile(tmp_path / "book.twbx", "w") as z:
        z.writestr("Data/shop.csv", "a,b\n1,2\n")
        z.writestr("book.twb", "<workbook/>")
    out = B.extracts(spark, f"file://{tmp_path}/book.twbx", f"file://{tmp_path}/out")
    assert spark.read.csv(out[0], header=True).collect()[0]["b"] == "2"
    assert B.extract_path(b, [], ["/up/other.csv", "/up/Shop.csv"]) == "/up/Shop.csv" and B.matching_table("orders", ["x_orders", "Orders"]) == "Orders" and B.matching_table("zz", ["a"]) is None


def test_visuals(spark):
    r = spark.range(1).select(visual_of(F.lit("Line")).alias("v"), visual_of(F.lit("?")).alias("u"), role_of(F.lit("rows")).alias("r")).first()
    assert [*r] == ["lineChart", "tableEx", "Values"] and grid(3) == [(0, 0, 640, 360), (640, 0, 640, 360), (0, 360, 640, 360)]
