"""Queries over level-of-detail aggregates and table calculations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lod as L
from ..operators import tablecalc as W
from ..operators.filters import Filter
from ..operators.model import rollup
from .common import table


def lod_fixed(spark, d):
    o = L.fixed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], F.sum("o_totalprice"), "of_customer")
    return o.select("o_orderkey", F.round("of_customer", 2).alias("of_customer"), F.round(F.col("o_totalprice") / F.col("of_customer"), 6).alias("part"))


def lod_fixed_total(spark, d):
    o = L.fixed(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [], F.avg("c_acctbal"), "mean")
    return o.select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 4).alias("above"))


def lod_exclude(spark, d):
    v = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("x"))
    return v.select("o_orderstatus", "o_orderpriority", F.round("x", 2).alias("x"), F.round(L.exclude(["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], F.sum("x")), 2).alias("of_status"))


def lod_include(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return L.include(j, ["c_mktsegment"], ["o_custkey"], F.sum("o_totalprice"), F.avg, "mean_of_customers").select("c_mktsegment", F.round("mean_of_customers", 4).alias("mean_of_customers"))


def filter_context_then_fixed(spark, d):
    """A context filter comes before FIXED, a dimension filter after it."""
    v = L.view(
        table(spark, d, "orders"), ["o_orderpriority"], {"n": F.count("*"), "part": F.round(F.sum(F.col("o_totalprice") / F.col("all")), 6)}, context=[Filter("o_orderstatus", "in", ["F", "O"])],
        filters=[Filter("o_orderpriority", "!=", "5-LOW")], fixed_levels={"all": ([], F.sum("o_totalprice"))}, having=F.col("n") > 0,
    )
    return v


def _monthly(spark, d):
    """Revenue in cents by priority and month: what table calculations run over. Whole cents add up alike in any order."""
    return table(spark, d, "orders").groupBy("o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).alias("x"))


def _shown(df, **columns):
    return df.select("o_orderpriority", F.col("month").cast("string").alias("month"), *[c.alias(k) for k, c in columns.items()])


_P, _M = ["o_orderpriority"], ["month"]


def win_running(spark, d):
    return _shown(_monthly(spark, d), **{k: F.round(W.running(f, "x", _P, _M), 4) for k, f in (("total", F.sum), ("mean", F.avg), ("low", F.min), ("high", F.max))}, n=W.running(F.count, "x", _P, _M))


def win_moving(spark, d):
    return _shown(_monthly(spark, d), back=F.round(W.moving(F.avg, "x", -2, 0, _P, _M), 2), around=F.round(W.moving(F.sum, "x", -1, 1, _P, _M), 2), low=F.round(W.moving(F.min, "x", -3, -1, _P, _M), 2))


def win_whole(spark, d):
    return _shown(_monthly(spark, d), share=F.round(W.share("x", _P), 6), high=F.round(W.whole(F.max, "x", _P), 2), mean=F.round(W.whole(F.avg, "x", _P), 4))


def win_ranks(spark, d):
    return _shown(_monthly(spark, d), **{k: F.round(c, 6) if k == "rank_percentile" else c for k, c in W.ranks("x", _P, ["month"]).items()})


def win_differences(spark, d):
    return _shown(_monthly(spark, d), difference=F.round(W.difference("x", _P, _M), 2), change=F.round(W.percent_change("x", _P, _M), 6), ahead=F.round(W.lookup("x", 2, _P, _M), 2), behind=F.round(W.lookup("x", -1, _P, _M), 2))


def win_positions(spark, d):
    return _shown(_monthly(spark, d), **W.positions(_P, _M))


def win_month_before(spark, d):
    return _shown(W.month_before(_monthly(spark, d), "month", "x", _P, "before"), before=F.round("before", 2))


def row_index(spark, d):
    return W.row_numbers(table(spark, d, "orders").repartition(7), ["o_orderdate", "o_orderkey"]).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def hierarchy_rollup(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rollup(j, ["r_name", "n_name"], {"n": F.count("*"), "balance": F.round(F.sum("c_acctbal"), 2)}).drop("level_mask")


QUERIES = {f.__name__: f for f in (lod_fixed, lod_fixed_total, lod_exclude, lod_include, filter_context_then_fixed, win_running, win_moving, win_whole, win_ranks, win_differences, win_positions, win_month_before, row_index, hierarchy_rollup)}

_V = "WITH v AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(round(o_totalprice * 100)) AS x FROM orders GROUP BY ALL) SELECT o_orderpriority, CAST(m AS VARCHAR) AS month, "
_BY = " FROM v WINDOW w AS (PARTITION BY o_orderpriority ORDER BY m), p AS (PARTITION BY o_orderpriority), r AS (PARTITION BY o_orderpriority ORDER BY x DESC), u AS (PARTITION BY o_orderpriority ORDER BY x DESC, m)"


def _frame(a: str, b: str) -> str:
    return f"(PARTITION BY o_orderpriority ORDER BY m ROWS BETWEEN {a} AND {b})"


ORACLE_SQL = {
    "lod_fixed": "SELECT o_orderkey, round(s, 2) AS of_customer, round(o_totalprice / s, 6) AS part FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders)",
    "lod_fixed_total": "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer",
    "lod_exclude": "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS x, round(sum(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 2) AS of_status FROM orders GROUP BY 1, 2",
    "lod_include": "SELECT c_mktsegment, round(avg(s), 4) AS mean_of_customers FROM (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1",
    "filter_context_then_fixed": "WITH c AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')), t AS (SELECT sum(o_totalprice) AS t FROM c) SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice / t), 6) AS part FROM c, t WHERE o_orderpriority <> '5-LOW' GROUP BY 1",
    "win_running": _V + "round(sum(x) OVER w, 2) AS total, round(avg(x) OVER w, 4) AS mean, round(min(x) OVER w, 2) AS low, round(max(x) OVER w, 2) AS high, count(x) OVER w AS n" + _BY,
    "win_moving": _V + f"round(avg(x) OVER {_frame('2 PRECEDING', 'CURRENT ROW')}, 2) AS back, round(sum(x) OVER {_frame('1 PRECEDING', '1 FOLLOWING')}, 2) AS around, round(min(x) OVER {_frame('3 PRECEDING', '1 PRECEDING')}, 2) AS low FROM v",
    "win_whole": _V + "round(x / sum(x) OVER p, 6) AS share, round(max(x) OVER p, 2) AS high, round(avg(x) OVER p, 4) AS mean" + _BY,
    "win_ranks": _V + "rank() OVER r AS rank, dense_rank() OVER r AS rank_dense, row_number() OVER u AS rank_unique, round(percent_rank() OVER r, 6) AS rank_percentile" + _BY,
    "win_differences": _V + "round(x - lag(x) OVER w, 2) AS difference, round(coalesce((x - lag(x) OVER w) / lag(x) OVER w, 0), 6) AS change, round(lead(x, 2) OVER w, 2) AS ahead, round(lag(x) OVER w, 2) AS behind" + _BY,
    "win_positions": _V + "row_number() OVER w AS index, count(*) OVER p AS size, 1 - row_number() OVER w AS first, count(*) OVER p - row_number() OVER w AS last" + _BY,
    "win_month_before": _V.replace("SELECT o_orderpriority, CAST(m", "SELECT v.o_orderpriority, CAST(v.m") + "round(b.x, 2) AS before FROM v LEFT JOIN v b ON b.o_orderpriority = v.o_orderpriority AND b.m + INTERVAL 1 MONTH = v.m",
    "row_index": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_index FROM orders",
    "hierarchy_rollup": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
