"""Quantiles, filters that fail alone, slices with nulls, join trees: against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkscope.operators import fidelity as V
from sparkscope.operators import filters as X
from sparkscope.operators.quantiles import quantiles
from sparkscope.sources import workbook as B


def at(values, q, discrete):
    v = sorted(values)
    if not v:
        return None
    if discrete:
        return v[max(math.ceil(len(v) * q) - 1, 0)]
    r = (len(v) - 1) * q
    low, high = v[math.floor(r)], v[math.ceil(r)]
    return low if low == high else low + (high - low) * (r - math.floor(r))


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles_of_groups_with_nulls_and_ties(spark, discrete):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.5, r.random(), float(r.randrange(5))])) for _ in range(500)] + [("empty", None)] * 3 + [("one", 4.0)] + [("hot", 7.0)] * 300
    orders = {"q0": 0.0, "q1": 0.1, "q33": 1 / 3, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in quantiles(df.repartition(6), ["g"], F.col("v"), orders, discrete).collect()}
    assert {*got} == {g for g, _ in rows}
    for g, x in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        for name, q in orders.items():
            want = at(own, q, discrete)
            assert x[name] is None if want is None else x[name] == pytest.approx(want, abs=1e-12), (g, name)
    total = quantiles(df, [], F.col("v"), {"m": 0.5}, discrete).collect()
    assert len(total) == 1 and total[0]["m"] == pytest.approx(at([v for _, v in rows if v is not None], 0.5, discrete))
    assert [tuple(x) for x in quantiles(df.limit(0), [], F.col("v"), {"m": 0.5}).collect()] == [(None,)] and quantiles(df.limit(0), ["g"], F.col("v"), {"m": 0.5}).collect() == []
    with pytest.raises(ValueError):
        quantiles(df, ["g"], F.col("v"), {"m": 1.5})


def test_bad_filters_are_told_and_the_others_hold(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", True), (3, None, False)], "n int, s string, f boolean")
    filters = [X.Filter("n", ">", 1), X.Filter("n", ">", "x"), X.Filter("s", "in", ["a", "b"]), X.Filter("n", "range", (None, None)), X.Filter("n", "range", (1,)), X.Filter("f", "=", None), X.Filter("n", "in", [1, None]), X.Filter("t", "=", 1), X.Filter("s", "matches", "a"), X.Filter("n", "startswith", "1"), X.Filter("f", "=", "true")]
    good, bad = X.checked(df, filters)
    assert [filters.index(f) for f in good] == [0, 2, 3, 10]
    assert [(r["place"], r["reason"]) for r in bad.orderBy("place").collect()] == [(1, X.NO_VALUE), (4, X.NO_VALUE), (5, X.NO_VALUE), (6, X.NO_VALUE), (7, X.NO_FIELD), (8, X.NO_OPERATOR), (9, X.NO_VALUE)]
    assert [r["n"] for r in X.apply_filters(df, good).collect()] == [2]
    assert X.checked(df, [])[1].count() == 0


def test_null_slices_keep_their_context_and_null_is_not_among_the_best(spark):
    rows = [(None, "x", 1.0), (None, None, 2.0), ("a", None, 3.0), ("a", "y", 4.0), ("b", "y", None)]
    df = spark.createDataFrame(rows, "k string, d string, v double")
    got = {(r["k"], r["d"]): r["candidate_value"] for r in V.in_context(df, ["k", "d"], ["k"], F.sum("v")).collect()}
    assert got == {(None, "x"): 3.0, (None, None): 3.0, ("a", None): 7.0, ("a", "y"): 7.0, ("b", "y"): None}
    assert {r["candidate_value"] for r in V.in_context(df, ["k"], [], F.sum("v")).collect()} == {10.0}
    assert {(r["k"], r["d"]): r["candidate_value"] for r in V.in_context(df, ["k", "d"], ["k", "d"], F.sum("v")).collect()}[None, None] == 2.0
    top = spark.createDataFrame([(None, 9), ("a", 5), ("b", 1), ("c", None)], "k string, v int")
    assert [r["k"] for r in X.top_n(top, "k", F.sum("v"), 2).orderBy("k").collect()] == ["a", "b"]


KINDS = {"inner": (False, False), "left": (True, False), "right": (False, True), "full": (True, True)}


def plain_join(left, right, same, kind):
    """Pairs of rows, None for a side that is missing."""
    keep_left, keep_right = KINDS[kind]
    out = [(x, y) for x in left for y in right if same(x, y)]
    out += [(x, None) for x in left if keep_left and not any(same(x, y) for y in right)]
    return out + [(None, y) for y in right if keep_right and not any(same(x, y) for x in left)]


@pytest.mark.parametrize(("one", "two"), [*itertools.product(KINDS, KINDS)])
def test_joins_keep_their_sides_in_either_order(spark, one, two):
    a, b, c = [(1, 10), (2, 20), (3, None)], [(10, 7), (20, 8), (40, 9), (None, 5)], [(7, "p"), (6, "q"), (None, "r")]
    tables = {"a": spark.createDataFrame(a, "x int, y int"), "b": spark.createDataFrame(b, "y int, z int"), "c": spark.createDataFrame(c, "z int, w string")}
    eq = lambda p, q: p is not None and p == q
    # a one-joined with b; then c, on the left, two-joined with what there is.
    ab = plain_join(a, b, lambda x, y: eq(x[1], y[0]), one)
    want = plain_join(c, ab, lambda z, p: p[1] is not None and eq(z[0], p[1][1]), two)
    flat = lambda z, p: (*((p and p[0]) or (None, None)), *((p and p[1]) or (None, None)), *(z or (None, None)))
    rows = [(one, "a", "y", "b", "y"), (two, "c", "z", "b", "z")]
    got = B.joined_tables(tables, spark.createDataFrame(rows, "join_type string, left_table string, left_column string, right_table string, right_column string"))
    assert got.columns == ["x", "y", "y (b)", "z", "z (c)", "w"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(flat(z, p)) for z, p in want)


def test_tables_used_twice_waiting_joins_and_forests(spark):
    t = {n: spark.createDataFrame([(1, 2), (2, 1)], "k int, v int") for n in ("a", "b", "c", "d")}
    schema = "join_type string, left_table string, left_column string, right_table string, right_column string"
    rows = [("inner", "a", "k", "b", "k"), ("left", "c", "k", "d", "k"), ("left", "b", "v", "c", "v"), ("left", "a", "v", "b", "k")]
    got = B.joined_tables(t, spark.createDataFrame(rows, schema))
    assert got.columns[:2] == ["k", "v"] and "k (b2)" in got.columns and len(got.columns) == 10 and got.count() == 2
    assert {(r["v"], r["k (b2)"]) for r in got.collect()} == {(1, 1), (2, 2)}
    with pytest.raises(ValueError):
        B.joined_tables(t, spark.createDataFrame(rows[:2], schema))
