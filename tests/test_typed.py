"""Exact values of any type, what sketches may drop, and discovery over keys that doubles can't tell apart."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.functions.typed import exact_text
from sparkscope.operators import profile as P
from sparkscope.operators import relationships as R
from sparkscope.operators import sketches as S
from sparkscope.operators.duplicates import jaccard
from sparkscope.operators.overlap import pair_overlaps, values_of

BIG = 1 << 60


def texts(spark, values, t):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", t)]))
    return [r[0] for r in df.select(exact_text(F.col("v"), t)).collect()]


def test_equal_values_of_unlike_types_meet(spark):
    whole = [0, 1, -7, BIG, BIG + 1, (1 << 63) - 1, None]
    want = [None if v is None else str(v) for v in whole]
    assert texts(spark, whole, T.LongType()) == want == texts(spark, [None if v is None else Decimal(v) for v in whole], T.DecimalType(38, 0)) == texts(spark, [None if v is None else Decimal(v) for v in whole], T.DecimalType(38, 4))
    assert texts(spark, [0.0, -0.0, 1.0, -7.0, float(BIG), 1e20], T.DoubleType()) == ["0", "0", "1", "-7", str(BIG), "1" + "0" * 20]
    assert texts(spark, [Decimal("0.1"), Decimal("0.00001"), Decimal("2.50"), Decimal("123.45600")], T.DecimalType(20, 5)) == texts(spark, [0.1, 1e-5, 2.5, 123.456], T.DoubleType())
    assert texts(spark, [Decimal("12345678901234567.5"), Decimal("12345678901234567.6")], T.DecimalType(38, 3)) == ["12345678901234567.5", "12345678901234567.6"]
    odd = texts(spark, [float("nan"), float("inf"), float("-inf"), 1e300, 1.5], T.DoubleType())
    assert odd == ["NaN", "Infinity", "-Infinity", "1.0E300", "1.5"]


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_decimals_and_doubles_are_equal_only_if_the_numbers_are(spark, seed):
    r = random.Random(seed)
    decimals = [Decimal(f"{r.choice(['', '-'])}{r.randrange(10 ** r.randrange(1, 27))}.{r.randrange(10 ** r.randrange(1, 10)):010d}") for _ in range(400)]
    found = texts(spark, decimals, T.DecimalType(38, 10))
    assert len(set(found)) == len(set(decimals))
    doubles = [float(d) for d in decimals]
    for t, d in zip(texts(spark, doubles, T.DoubleType()), doubles):
        assert Decimal(t) == (Decimal(int(d)) if d == int(d) and abs(d) < 2**63 else Decimal(repr(d)))


def test_wide_keys_are_counted_exactly(spark):
    df = spark.range(1000).select((F.col("id") + BIG).alias("a"), (F.col("id") + BIG + 1000).cast("decimal(38,0)").alias("b"), F.col("id").cast("double").alias("c"))
    p = {r["column"]: r for r in P.column_profiles(df, "t").collect()}
    assert [(p[c]["unique_count"], p[c]["is_unique"], p[c]["is_sequential"]) for c in "abc"] == [(1000, True, True)] * 3
    assert {r["column"]: (r["unit_steps"], r["is_sequential"]) for r in P.sequential(df, ["a", "b", "c"]).collect()} == dict.fromkeys("abc", (999, True))
    assert pair_overlaps(values_of({"x": df.select("a"), "y": df.select("b")})).collect() == []
    assert jaccard(df, "a", "b").first()[0] == 0.0
    left, right = df.select(F.col("a").alias("key")), df.select((F.col("b") - 500).cast("decimal(38,0)").alias("key"))
    r = R.discover({"x": left, "y": right}).collect()
    assert [(x["overlap_percent"], x["exact_matches"], x["orphans_in_source"], x["requires_validation"]) for x in r] == [(50.0, 500, 500, True)]
    assert R.discover({"x": left, "y": df.select(F.col("b").alias("key"))}).collect() == []


def test_sequences_from_ends_agree_with_the_values(spark):
    r = random.Random(1)
    for _ in range(300):
        values = [r.choice([r.randrange(60), r.randrange(10), k]) for k in range(r.randrange(1, 50))]
        distinct = sorted(set(values))
        units = sum(b - a == 1 for a, b in itertools.pairwise(distinct))
        want = len(values) > 1 and units > 0.95 * (len(values) - 1)
        assert P.surely_sequential(len(values), len(distinct), distinct[0], distinct[-1]) in (want, None)
    assert P.surely_sequential(100, 100, 1, 100) is True and P.surely_sequential(100, 100, 1, 1000) is None
    gaps = spark.createDataFrame([(i + (1 << 40) * (i > 500),) for i in range(1000)], "a long")
    assert P.column_profiles(gaps, "t").first()["is_sequential"] is True


@pytest.mark.parametrize(("n1", "n2", "shared"), [(100, 80, 40), (100, 80, 31), (100, 80, 0), (3, 50_000, 2), (30_000, 50_000, 13_000), (30_000, 50_000, 1000), (20_000, 20_000, 0), (50, 50_000, 0)])
def test_sketches_drop_only_pairs_that_cannot_qualify(spark, n1, n2, shared):
    a, b = spark.range(n1).select(F.col("id").alias("k")), spark.range(n1 - shared, n1 - shared + n2).select(F.col("id").cast("string").alias("k"))
    facts = S.column_facts({"x": a.repartition(5), "y": b.repartition(3)}, {"x": ["k"], "y": ["k"]})
    e = S.estimated(facts, spark.createDataFrame([("x", "k", "y", "k")], "table1 string, column1 string, table2 string, column2 string")).first()
    percent = shared * 100 / min(n1, n2)
    for least in (40, 50, 60):
        if percent >= least:
            assert S.can_reach(least, e["n1"], e["n2"], e["shared"])
    if max(n1, n2) < 4096 or min(n1, n2) > 10_000 and percent < 10:
        assert S.can_reach(40, e["n1"], e["n2"], e["shared"]) == (percent >= 40)
    f = {r["table"]: r for r in facts.collect()}
    assert (f["x"]["rows"], f["x"]["non_null"], f["y"]["numbers"]) == (n1, n1, n2)


def brute(tables):
    """Relationships by equal and varied names, from whole values on the driver."""
    rows = {t: df.toPandas() for t, df in tables.items()}
    found = set()
    for s, t in itertools.combinations(sorted(tables), 2):
        for c in rows[s]:
            for d in rows[t]:
                x, y = ({str(int(v)) if not isinstance(v, str) else v for v in z.dropna()} for z in (rows[s][c], rows[t][d]))
                if x and y and c == d and len(x & y) * 100 / min(len(x), len(y)) >= 80 and (rows[s][c].dropna().is_unique or rows[t][d].dropna().is_unique):
                    found.add((s, c, t, d, len(x & y)))
    return found


def test_discovery_agrees_with_whole_values(spark):
    r = random.Random(3)
    tables = {}
    for t in "abc":
        n = r.randrange(20, 60)
        tables[t] = spark.createDataFrame([(i + (BIG if t != "a" else 0), r.choice([None, r.randrange(20)]), f"n{r.randrange(40)}", BIG + i * 2) for i in range(n)], "key long, ref int, name string, wide long")
    got = R.discover(tables)
    assert {(x["source_table"], x["source_column"], x["target_table"], x["target_column"], x["exact_matches"]) for x in got.where("detection_method = 'EXACT_NAME_AND_TYPE_MATCH'").collect()} == brute(tables)
    assert R.discover({k: df.limit(0) for k, df in tables.items()}).collect() == []


def test_changes_of_format_survive_the_sketches(spark):
    a = spark.createDataFrame([(f"CUST-{i}", f"Town {i}", f"zone/x{i}") for i in range(50)], "cust_code string, town string, zone_id string")
    b = spark.createDataFrame([(i, f"TOWN {i}", f"x{i}") for i in range(50)], "cust_code int, town string, zone_id string")
    found = {r["source_column"]: (r["detection_method"], r["overlap_percent"]) for r in R.discover({"a": a, "b": b}).where("relationship_type = 'FORMAT_MISMATCH'").collect()}
    assert found == {"cust_code": ("PREFIX_MISMATCH", 100.0), "town": ("CASE_MISMATCH", 100.0), "zone_id": ("PARTIAL_MATCH", 100.0)}
