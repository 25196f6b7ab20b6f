"""Every registered query of the library against its SQL on the smallest tables; the rest against what is known of them."""

import math
import os

import duckdb
import pytest

from sparkscope.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_relationships_of_the_star(spark, sf_dir):
    found = {(r["source_column"], r["target_column"]): r for r in QUERIES["relationship_report"](spark, sf_dir).collect()}
    r = found["c_custkey", "o_custkey"]
    assert (r["relationship_type"], r["requires_validation"], r["overlap_percent"]) == ("SEMANTIC_MATCH", True, 100.0)
    assert len({r["relationship_id"] for r in found.values()}) == len(found)


def test_pairs_and_report_cover_every_star_table(spark, sf_dir):
    pairs = {(r["column1"], r["column2"]) for r in QUERIES["overlap_all_pairs"](spark, sf_dir).collect()}
    assert ("l_partkey", "p_partkey") in pairs and any("user_id" in p for p in pairs)
    found = {frozenset((r["source_column"], r["target_column"])) for r in QUERIES["relationship_report"](spark, sf_dir).collect()}
    assert {frozenset(("l_partkey", "p_partkey")), frozenset(("l_orderkey", "o_orderkey"))} <= found


def test_rules_by_name(spark, sf_dir):
    found = {(r["source_column"], r["target_column"]): r for r in QUERIES["rel_rules"](spark, sf_dir).collect()}
    assert found["cust_id", "cust_id"]["confidence_score"] == 95
    assert found["cust_id", "customer_id"]["detection_method"] == "NAME_VARIATION_MATCH"


def test_fuzzy_matches_need_likeness(spark):
    from sparkscope.operators.relationships import fuzzy_overlap

    a = spark.createDataFrame([("blue lamp large",), ("red chair",), ("same",), ("x",)], "value string")
    b = spark.createDataFrame([("large blue lamps",), ("green table",), ("same",)], "value string")
    r = fuzzy_overlap(a, b).first()
    assert (r["exact_matches"], r["fuzzy_matches"]) == (1, 1)


def test_workbook(spark, sf_dir):
    fields = {r["name"]: r for r in QUERIES["workbook_fields"](spark, sf_dir).collect()}
    assert fields["Calculation_1"]["formula"] == "SUM([o_totalprice])"
    parameters = {r["name"]: r for r in QUERIES["workbook_parameters"](spark, sf_dir).collect()}
    assert (parameters["Top N"]["members"], parameters["Rate"]["step"]) == (["5", "10", "20"], 0.1)
    sheet = QUERIES["workbook_worksheets"](spark, sf_dir).first()
    assert (sheet["rows"], sheet["cols"], sheet["encodings"]) == (["o_totalprice"], ["o_orderstatus"], ["o_orderpriority"])
    f = QUERIES["workbook_filters"](spark, sf_dir).first()
    assert (f["field"], f["context"], f["members"]) == ("o_orderstatus", True, ["F"])


def test_kinds_of_calculations(spark, sf_dir):
    kinds = {r["name"]: (r["kind"], r["granularity"]) for r in QUERIES["graph_kinds"](spark, sf_dir).collect()}
    assert kinds == {"Revenue": ("MEASURE", "AGGREGATE"), "Cost": ("MEASURE", "AGGREGATE"), "Profit": ("MEASURE", "ROW"), "Margin": ("MEASURE", "ROW"), "Run": ("TABLE_CALCULATION", "TABLE"), "PerCust": ("LOD_EXPRESSION", "AGGREGATE"), "Band": ("COLUMN", "ROW")}
