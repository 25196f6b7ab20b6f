"""Distinct values are grouped by their own type, and facts make a value's text once a row."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from sparkscope.functions.typed import as_number
from sparkscope.operators import profile as P


def rows(spark):
    d, t = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 5)
    data = [(1, 0.0, 1.5, d, t, "a", Decimal("1.50"), True), (1, -0.0, float("nan"), d, t, "", Decimal("1.50"), None), (None, 1.0, float("nan"), None, None, None, None, None), (1 << 62, 1e300, 2.5, d, t, "1", Decimal("2.00"), False)]
    return spark.createDataFrame(data, "i long, x double, f float, d date, t timestamp_ntz, s string, m decimal(9,2), b boolean")


def test_values_equal_those_grouped_as_text(spark):
    df = rows(spark)
    found = {tuple(r) for r in P.distinct_values({"t": df}).collect()}
    assert found == {("t", *r) for r in P.frequencies(df).collect()}
    assert ("t", "x", "0", 2) in found and ("t", "f", "NaN", 2) in found and ("t", "i", str(1 << 62), 1) in found


def test_numbers_and_times_are_not_grouped_as_text(spark):
    plan = P.distinct_values({"t": rows(spark).select("i", "x", "d", "t")})._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "Aggregate [" not in line]  # texts are made of the groups, in the aggregates' results
    assert any("Generate" in line for line in below) and not any("as string" in line for line in below)


def test_summary_needs_no_statistics(spark):
    p = P.profiles_from({"t": rows(spark)}, P.distinct_values({"t": rows(spark)}), statistics=False)
    full = P.column_profiles(rows(spark), "t")
    assert P.table_summary(p).collect() == P.table_summary(full).collect()
    assert p.where("mean is not null").count() == 0 < full.where("mean is not null").count()


def test_guarded_cast_equals_the_cast(spark):
    texts = ["1", " 1.5e3 ", "-.5", "+7", "Infinity", "-inf", "NaN", "nan", "1d", "2f", "0x1p3", "1-URGENT", "O", "F", "", " ", "1998-02-06", "Customer#1", "\t3\n", "1e", ".", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").try_cast("double").cast("string").alias("a"), as_number(F.col("t")).cast("string").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is not None for r in got) >= 8
