"""Operators on small tables: nulls, empty tables, ties, known values, streams."""

import json

import pytest
from pyspark.sql import functions as F

from sparkscope.functions import names as N
from sparkscope.operators import duplicates as D
from sparkscope.operators import fidelity as V
from sparkscope.operators import graph as G
from sparkscope.operators import profile as P
from sparkscope.operators.filters import what_if_of_list
from sparkscope.operators.model import calendar
from sparkscope.operators.relationships import discover
from sparkscope.plans.discovery import Discovery
from sparkscope.sources import sinks, tables
from sparkscope.streaming import incremental as I  # noqa: E741


def test_names():
    assert {N.normalized(n) for n in ("CustomerID", "customer_id", "Customer ID")} == {"customerid"}
    assert {*N.variations("cust_id")} == {"custid", "custidentifier", "custkey", "customerid", "clientid"}
    assert N.token_ratio("o_custkey", "c_custkey") == pytest.approx(16 / 18)
    assert N.token_ratio("Agent_Code", "agt_code") == pytest.approx(12 / 18)
    assert N.token_ratio("CUST-001", "001") == pytest.approx(6 / 11)
    assert N.matcher_ratio("custkey", "c_custkey") == pytest.approx(14 / 16)
    assert N.token_ratio(None, "x") is None
    assert N.table_name("Extract.Meeting_C95B117F736D4522AE7C2584C4641D3A") == "Meeting"
    assert N.table_name("gcrm!opportunity!2020") == "Opportunity"
    assert (N.split_field("Sales.Region"), N.split_field("Region")) == (("Sales", "Region"), ("", "Region"))
    assert what_if_of_list([5, 10, 20], 10) == {"low": 5, "high": 20, "step": 5, "default": 10}


def test_profiles_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, ""), (2, None, "a"), (2, None, None)], "a int, b string, c string")
    rows = {r["column"]: r for r in P.nulls(df).collect()}
    assert (rows["b"]["null_percent"], rows["c"]["empty_count"], rows["c"]["null_count"]) == (100.0, 1, 1)
    unique = {r["column"]: r for r in P.uniqueness(df).collect()}
    assert (unique["a"]["unique_count"], unique["a"]["duplicate_count"], unique["b"]["unique_percent"]) == (2, 1, 0.0)
    assert P.nulls(df.limit(0)).agg(F.sum("row_count")).first()[0] == 0
    r = P.duplicate_rows(df.limit(0)).first()
    assert (r["row_count"], r["duplicate_rate"], r["status"]) == (0, 0.0, "good")
    assert {r["column"]: r["data_type"] for r in P.inferred_types(df, ["a", "b", "c"]).collect()} == {"a": "int", "b": "unknown", "c": "string"}


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 1, 4), (3, 2, 6), (4, 3, 6)], "a int, b int, c int")
    found = {r["column"]: (r["steps"], r["unit_steps"], r["is_sequential"]) for r in P.sequential(df, ["a", "b", "c"]).collect()}
    assert found == {"a": (3, 3, True), "b": (3, 2, False), "c": (3, 0, False)}


@pytest.mark.parametrize(
    "candidate, passed, kind",
    [(100.0, True, "PERFECT_MATCH"), (100.005, True, "PERFECT_MATCH"), (1.0, False, "SCALE_ERROR"), (1000.0, False, "SCALE_ERROR"), (None, False, "NULL_HANDLING"), (120.0, False, "CONTEXT_SHIFT"), (107.0, False, "GRAIN_MISMATCH"), (102.0, False, "AGGREGATION_MISMATCH")],
)
def test_kinds_of_errors(spark, candidate, passed, kind):
    t, c = spark.createDataFrame([("k", 100.0)], "d string, truth_value double"), spark.createDataFrame([("k", candidate)], "d string, candidate_value double")
    r = V.compare(t, c, ["d"]).first()
    assert (r["passed"], r["error_category"]) == (passed, kind)


def test_slices_meet_by_null_and_extra_ones_are_kept(spark):
    t = spark.createDataFrame([(None, 0.0), ("a", None), ("b", 5.0)], "d string, truth_value double")
    c = spark.createDataFrame([(None, 500.0), ("a", None), ("z", 1.0)], "d string, candidate_value double")
    found = {r["d"]: r["error_category"] for r in V.compare(t, c, ["d"], keep_extra=True).collect()}
    assert found == {None: "NULL_HANDLING", "a": "PERFECT_MATCH", "b": "MISSING_VALUE", "z": "EXTRA_VALUE"}
    assert V.verdict(V.compare(t.limit(0), c, ["d"])).first()["overall_passed"] is False


def test_cycles_have_no_level(spark):
    calcs = spark.createDataFrame([("a", "[b]+1"), ("b", "[a]+1"), ("c", "SUM([x])"), ("d", "1")], "name string, formula string")
    assert {r["name"]: r["level"] for r in G.levels(calcs).collect()} == {"a": None, "b": None, "c": 1, "d": 1, "x": 0}


def test_fiscal_calendar(spark):
    rows = {str(r["Date"]): (r["FiscalYear"], r["FiscalQuarter"], r["FiscalMonth"]) for r in calendar(spark, "2024-06-15", "2024-07-15", 7).collect()}
    assert (rows["2024-07-15"], rows["2024-06-15"]) == ((2025, 1, 1), (2024, 4, 12))


def test_duplicate_columns_by_each_rule(spark):
    df = spark.range(20).select(F.col("id").alias("AgentName"), F.col("id").alias("agent_name"), (F.col("id") * 2).alias("score_2"), (F.col("id") * 3).alias("score"), F.lit("x").alias("other"))
    found = {g["rule"]: g["columns"] for g in D.duplicate_columns(df)}
    assert found["exact_name"] == ["AgentName", "agent_name"] and found["suffix"] == ["score_2", "score"]


def test_files_are_loaded_and_cleaned(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,id,,blank\n1,x,7,\n2,y,8,\n,,,\n")
    df = tables.load_tables(spark, [str(tmp_path / "a.csv")])[str(tmp_path / "a.csv")]
    assert (df.count(), len(df.columns)) == (2, 3)
    assert tables.unique_names(["id", "id", "", " x "]) == ["id", "id_1", "Unnamed_2", "x"]
    with pytest.raises(ValueError):
        tables.file_format("a.txt")
    with pytest.raises(ValueError):
        tables.load_tables(spark, [])


def test_reports(spark):
    a = spark.range(100).select(F.col("id").alias("cust_id"), F.concat(F.lit("n"), "id").alias("label"))
    b = spark.range(300).select((F.col("id") % 100).alias("cust_id"), F.col("id").alias("order_no"))
    body = json.loads(Discovery({"a": a, "b": b}).report())
    assert body["metadata"]["HIGH"] >= 1 and {*body["tables"]} == {"a", "b"}
    assert sinks.literal_table(spark.createDataFrame([('say "x"', 1.0, None)], "s string, d double, n int"), 5, ["s"]).startswith('DATATABLE("s", STRING, "d", DOUBLE, "n", INTEGER')
    assert discover({"a": a.limit(0), "b": b.limit(0)}).isEmpty()


def test_stream_profile_equals_the_batch_one(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = I.windowed_profile(stream, "ts", "event_type", "value", "1 day", "1 hour")
    q = out.writeStream.format("memory").queryName("profiles").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = I.windowed_profile(events, "ts", "event_type", "value", "1 day")
    text = lambda df: sorted(map(tuple, df.withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")}).collect()))
    assert text(spark.table("profiles")) == text(want)


def test_medians_of_groups_with_nulls_ties_and_many_ranges(spark):
    import math
    import random
    import statistics

    from pyspark.sql import functions as F

    from sparkscope.operators.quantiles import medians

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, rng.gauss(0, 9), float(rng.randrange(5))])) for _ in range(900)]
    rows += [("hot", float(rng.randrange(3))) for _ in range(500)] + [("none", None), ("one", 4.0), ("two", 1.0), ("two", 2.0), ("nan", math.nan)]
    df = spark.createDataFrame(rows, "v string, n double").repartition(7)
    want = {}
    for k, x in rows:
        want.setdefault(k, []).extend([] if x is None else [x])
    want = {k: statistics.median(x) if x else None for k, x in want.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["v"]: r["median"] for r in medians(df, ["v"], F.col("n")).collect()}
        whole = medians(df.where("v = 'a'"), [], F.col("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert math.isnan(found.pop("nan")) and math.isnan(want.pop("nan"))
    assert found == want
    assert [r["median"] for r in whole] == [want["a"]]
    assert medians(df.limit(0), ["v"], F.col("n")).collect() == []


def test_fuzzy_matches_are_those_of_all_pairs(spark):
    import random

    from sparkscope.functions.names import token_ratio
    from sparkscope.operators.overlap import FUZZY, fuzzy_matches

    rng = random.Random(3)
    base = ["Anna Maria Lopez", "CUST-001", "C", "  ", "Müller GmbH", "aaaaaaaaaa", "x y z"] + ["".join(rng.choice("abcde 19") for _ in range(rng.randrange(1, 25))) for _ in range(60)]

    def bent(s):
        out = list(s)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", " "])
        return "".join(out)

    left, right = sorted(set(base)), sorted({bent(s) for s in base for _ in range(3)})
    mine, theirs = set(left) - set(right), set(right) - set(left)
    want = {a for a in mine if any(token_ratio(a, b) > FUZZY for b in theirs)}
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "value string")
    found = [r["value"] for r in fuzzy_matches(frame(left), frame(right)).collect()]
    assert len(want) > 20 and sorted(found) == sorted(want)
