"""Queries over aggregates, calculated fields, filters and parameters, and their SQL."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calc as C
from ..operators import filters as X
from ..operators.quantiles import medians, quantiles
from .common import table


def agg_basic(spark, d):
    """Measures by two dimensions; the median from ranks, not from a group's values in one task."""
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    dims = ["l_returnflag", "l_linestatus"]
    made = li.groupBy(*dims).agg(F.round(F.sum(q), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.min(q).alias("min_qty"), F.max(q).alias("max_qty"))
    middle = medians(li, dims, q, "median_qty").select(*[F.col(k).alias(f"of_{k}") for k in dims], "median_qty")
    return made.join(middle, reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in dims])).drop(*[f"of_{k}" for k in dims])


def agg_percentiles(spark, d):
    """Six orders of prices by ship mode of the year, interpolated, null dates among the groups."""
    li = table(spark, d, "lineitem").withColumn("year", F.when(F.col("l_linenumber") != 3, F.year("l_shipdate")))
    return quantiles(li, ["l_returnflag", "year"], F.col("l_extendedprice"), {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0})


def agg_percentiles_discrete(spark, d):
    """Values that rows have, of all rows and with nulls in the measure."""
    v = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return quantiles(table(spark, d, "orders"), [], v, {"p1": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99}, discrete=True)


def agg_dispersion(spark, d):
    v = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(*[F.round(C.AGGREGATES[k](v), 4).alias(k) for k in ("var", "varp", "stdev", "stdevp")])


def agg_ratio_safe(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(C.divide(F.sum("l_discount"), F.sum("l_tax"), 0.0), 6).alias("ratio"), C.divide(F.sum("l_discount"), F.sum(F.lit(0.0)), 0.0).alias("by_zero"))


def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.countDistinct("l_orderkey").alias("orders"))


def agg_attr(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(C.attribute(F.col("o_orderstatus")).alias("status"), F.count("*").alias("n"))


def formula_bands(spark, d):
    p = F.col("o_totalprice")
    band = C.bands((p < 50_000, "small"), (p < 150_000, "medium"), (p < 300_000, "large"), other="huge")
    return table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("total"), F.sum(C.iif(F.col("o_orderstatus") == "F", F.lit(1), F.lit(0))).alias("finished"))


def formula_nulls(spark, d):
    v = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", C.zn(v).alias("zn"), C.ifnull(v, F.lit(-1.0)).alias("ifnull"), v.isNull().alias("isnull"), C.iif(v > 100_000, F.lit("yes"), F.lit("no")).alias("iif"))


def formula_text(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.count_if(C.contains(F.col("p_name"), "part")).alias("has_part"), F.count_if(C.contains(F.col("p_name"), "%")).alias("has_percent"), F.count_if(C.same_text(F.col("p_type"), "economy")).alias("economy"), F.count("*").alias("n"))


def formula_dates(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return j.groupBy(C.datepart("year", a).alias("year"), C.datepart("quarter", a).alias("quarter")).agg(F.count("*").alias("n"), *[F.sum(C.datediff(k, a, b)).alias(f"{k}s") for k in ("day", "month", "quarter", "year")])


def shelf_date_parts(spark, d):
    return table(spark, d, "events").groupBy(*[f(F.col("ts")).cast("long").alias(k) for k, f in C.DATE_PARTS.items()]).agg(F.count("*").alias("n"))


def formula_divide(spark, d):
    v = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.divide(v, F.col("l_discount"), -1.0), 4).alias("alt"), F.round(C.divide(v, F.col("l_discount")), 4).alias("plain"))


def formula_calculate(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(C.calculate(F.sum, F.col("o_totalprice"), F.col("o_orderstatus") == "O"), 2).alias("open_total"), C.calculate(F.countDistinct, F.col("o_custkey"), F.col("o_totalprice") > 100_000).alias("big_customers"))


def formula_nested(spark, d):
    revenue, cost = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * F.col("l_discount"))
    profit = revenue - cost
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(profit, 2).alias("profit"), F.round(C.divide(profit, revenue, 0.0), 6).alias("margin"))


def filter_equality_map(spark, d):
    return X.equal_to(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "not_there": 1}).select("o_orderkey", "o_custkey")


_FILTERS = [
    ("=", "c_mktsegment", "BUILDING"), ("!=", "c_mktsegment", "BUILDING"), (">", "c_acctbal", 5000.0), (">=", "c_nationkey", 10), ("<", "c_acctbal", 0.0), ("<=", "c_nationkey", 10), ("in", "c_nationkey", [1, 2, 3]), ("not in", "c_nationkey", [1, 2, 3]),
    ("contains", "c_name", "00"), ("startswith", "c_name", "Customer"), ("endswith", "c_name", "7"), ("range", "c_acctbal", (0.0, None)),
]


def filter_ops_all(spark, d):
    """All predicates are counted in one scan."""
    out = table(spark, d, "customer").agg(*[F.count_if(X.Filter(c, o, v).predicate()).alias(f"f{i}") for i, (o, c, v) in enumerate(_FILTERS)])
    return out.select(F.inline(F.array(*[F.struct(F.lit(o).alias("operator"), F.col(f"f{i}").alias("n")) for i, (o, _, _) in enumerate(_FILTERS)])))


def filter_relative_date(spark, d):
    return X.last_days(table(spark, d, "events"), "ts", 7).groupBy("event_type").agg(F.count("*").alias("n"))


def filter_top_n(spark, d):
    return X.top_n(table(spark, d, "orders"), "o_custkey", F.sum("o_totalprice"), 10).select("o_orderkey", "o_custkey", "o_totalprice")


_MIXED = [("=", "o_orderstatus", "O"), (">", "o_totalprice", "much"), ("like", "o_clerk", "x"), ("range", "o_orderdate", ("1994-01-01", "1996-12-31 00:00:00")), ("in", "o_custkey", [1, "two"]), ("contains", "o_totalprice", "1"), ("<", "no_such", 3), ("range", "o_totalprice", (1000, None)), ("startswith", "o_orderpriority", "1"), ("~", "o_orderkey", 1)]


def filter_checked(spark, d):
    """Good and bad filters on orders: what the good ones leave together, and why the others were left out."""
    o = table(spark, d, "orders")
    good, bad = X.checked(o, [X.Filter(c, op, v) for op, c, v in _MIXED])
    kept = X.apply_filters(o, good).agg(F.lit(-1).cast("long").alias("place"), F.lit("all").alias("field"), F.lit("and").alias("operator"), F.lit("").alias("reason"), F.count("*").alias("n"))
    return kept.unionByName(bad.withColumn("n", F.lit(0).cast("long")))


def filter_top_n_nulls(spark, d):
    """The best three of a dimension with nulls, which are most of its rows."""
    o = table(spark, d, "orders").withColumn("who", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")))
    return X.top_n(o, "who", F.sum("o_totalprice"), 3).groupBy("who").agg(F.count("*").alias("n"))


def filter_predicates(spark, d):
    return X.all_of(table(spark, d, "orders"), ["o_totalprice > 100000", "o_orderstatus = 'O' OR o_orderstatus = 'P'"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def pagination(spark, d):
    return X.page(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 40, 20).select("o_orderkey", "o_totalprice")


def manual_sort(spark, d):
    at = X.by_list(F.col("o_orderpriority"), ["5-LOW", "1-URGENT", "3-MEDIUM"])
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", at.cast("long"))


def bins_groups_sets(spark, d):
    group = X.group_of(F.col("p_brand"), {"first": ["Brand#11", "Brand#12"], "second": ["Brand#21", "Brand#22"]}, "Other")
    return table(spark, d, "part").groupBy(C.bin_of(F.col("p_size"), 10).cast("long").alias("bin"), group.alias("brand_group"), F.col("p_size").isin(1, 2, 3).alias("in_set")).agg(F.count("*").alias("n"))


def whatif_series(spark, d):
    return X.what_if(spark, **X.what_if_of_list([5, 10, 20], 10))


def slicer_values(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).where("value is not null").distinct()


def slicer_selected(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(X.selected_value(F.col("o_orderstatus"), "many").alias("one"), X.selected_value(F.col("o_orderpriority"), "many").alias("several"))


def param_bound_query(spark, d):
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY o_orderpriority", args={"least": 200_000.0}, orders=table(spark, d, "orders"))


def set_operations(spark, d):
    """Union, intersection and difference of two sets of keys."""
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    made: list[DataFrame] = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in (("union_all", a.unionAll(b)), ("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", b.subtract(a)))]
    return reduce(DataFrame.unionByName, made)


QUERIES = {
    f.__name__: f
    for f in (
        agg_basic, agg_dispersion, agg_ratio_safe, agg_global, agg_attr, formula_bands, formula_nulls, formula_text, formula_dates, shelf_date_parts, formula_divide, formula_calculate, formula_nested, filter_equality_map, filter_ops_all,
        filter_relative_date, filter_top_n, filter_top_n_nulls, filter_checked, agg_percentiles, agg_percentiles_discrete, filter_predicates, pagination, manual_sort, bins_groups_sets, whatif_series, slicer_values, slicer_selected, param_bound_query, set_operations,
    )
}

_OPS = [
    ("=", "c_mktsegment = 'BUILDING'"), ("!=", "c_mktsegment <> 'BUILDING'"), (">", "c_acctbal > 5000"), (">=", "c_nationkey >= 10"), ("<", "c_acctbal < 0"), ("<=", "c_nationkey <= 10"), ("in", "c_nationkey IN (1, 2, 3)"),
    ("not in", "c_nationkey NOT IN (1, 2, 3)"), ("contains", "contains(c_name, '00')"), ("startswith", "starts_with(c_name, 'Customer')"), ("endswith", "ends_with(c_name, '7')"), ("range", "c_acctbal >= 0"),
]
_MONTHS = "(year({b}) * 12 + month({b}) - year({a}) * 12 - month({a}))"

_GROUPS = "SELECT l_returnflag, CASE WHEN l_linenumber <> 3 THEN year(l_shipdate) END AS year, l_extendedprice AS v FROM lineitem"

ORACLE_SQL = {
    "agg_percentiles": f"SELECT l_returnflag, year, {', '.join(f'quantile_cont(v, {q}) AS {n}' for n, q in (('p0', 0.0), ('p5', 0.05), ('p50', 0.5), ('p90', 0.9), ('p999', 0.999), ('p100', 1.0)))} FROM ({_GROUPS}) GROUP BY ALL",
    "agg_percentiles_discrete": f"SELECT {', '.join(f'quantile_disc(v, {q}) AS {n}' for n, q in (('p1', 0.01), ('p25', 0.25), ('p75', 0.75), ('p99', 0.99)))} FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders)",
    "filter_checked": """SELECT -1::BIGINT AS place, 'all' AS field, 'and' AS operator, '' AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' AND o_totalprice >= 1000 AND o_orderpriority LIKE '1%'
UNION ALL SELECT 1, 'o_totalprice', '>', 'the value doesn''t fit the column', 0 UNION ALL SELECT 2, 'o_clerk', 'like', CASE WHEN (SELECT count(*) FROM (DESCRIBE orders) WHERE column_name = 'o_clerk') = 0 THEN 'no such column' ELSE 'no such operator' END, 0 UNION ALL SELECT 4, 'o_custkey', 'in', 'the value doesn''t fit the column', 0
UNION ALL SELECT 5, 'o_totalprice', 'contains', 'the value doesn''t fit the column', 0 UNION ALL SELECT 6, 'no_such', '<', 'no such column', 0 UNION ALL SELECT 9, 'o_orderkey', '~', 'no such operator', 0""",
    "filter_top_n_nulls": "SELECT o_custkey AS who, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3) GROUP BY 1",
    "agg_basic": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, median(l_quantity) AS median_qty FROM lineitem GROUP BY ALL",
    "agg_dispersion": "SELECT c_mktsegment, round(var_samp(c_acctbal), 4) AS var, round(var_pop(c_acctbal), 4) AS varp, round(stddev_samp(c_acctbal), 4) AS stdev, round(stddev_pop(c_acctbal), 4) AS stdevp FROM customer GROUP BY 1",
    "agg_ratio_safe": "SELECT l_returnflag, round(CASE WHEN sum(l_tax) = 0 THEN 0.0 ELSE sum(l_discount) / sum(l_tax) END, 6) AS ratio, 0.0::DOUBLE AS by_zero FROM lineitem GROUP BY 1",
    "agg_global": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_orderkey) AS orders FROM lineitem",
    "agg_attr": "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status, count(*) AS n FROM orders GROUP BY 1",
    "formula_bands": "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS band, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1",
    "formula_nulls": "SELECT o_orderkey, coalesce(v, 0) AS zn, coalesce(v, -1) AS ifnull, v IS NULL AS isnull, CASE WHEN v > 100000 THEN 'yes' ELSE 'no' END AS iif FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders)",
    "formula_text": "SELECT p_brand, count(*) FILTER (contains(p_name, 'part')) AS has_part, count(*) FILTER (contains(p_name, '%')) AS has_percent, count(*) FILTER (lower(p_type) = 'economy') AS economy, count(*) AS n FROM part GROUP BY 1",
    "formula_dates": f"SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS n, CAST(sum(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(sum({_MONTHS.format(a='o_orderdate', b='l_shipdate')}) AS BIGINT) AS months, CAST(sum(year(l_shipdate) * 4 + quarter(l_shipdate) - year(o_orderdate) * 4 - quarter(o_orderdate)) AS BIGINT) AS quarters, CAST(sum(year(l_shipdate) - year(o_orderdate)) AS BIGINT) AS years FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "shelf_date_parts": "SELECT year(ts) AS yr, quarter(ts) AS qr, month(ts) AS mn, day(ts) AS dy, week(ts) AS wk, count(*) AS n FROM events GROUP BY ALL",
    "formula_divide": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN -1 ELSE l_extendedprice / l_discount END, 4) AS alt, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 4) AS plain FROM lineitem",
    "formula_calculate": "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS open_total, count(DISTINCT o_custkey) FILTER (o_totalprice > 100000) AS big_customers FROM orders GROUP BY 1",
    "formula_nested": "SELECT l_returnflag, round(sum(l_extendedprice) - sum(l_extendedprice * l_discount), 2) AS profit, round((sum(l_extendedprice) - sum(l_extendedprice * l_discount)) / sum(l_extendedprice), 6) AS margin FROM lineitem GROUP BY 1",
    "filter_equality_map": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "filter_ops_all": " UNION ALL ".join(f"SELECT '{o}' AS operator, count(*) FILTER ({p}) AS n FROM customer" for o, p in _OPS),
    "filter_relative_date": "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "filter_top_n": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10)",
    "filter_predicates": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_orderstatus = 'P') GROUP BY 1",
    "pagination": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40",
    "manual_sort": "SELECT o_orderpriority, count(*) AS n, coalesce(nullif(list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority), 0), 4)::BIGINT AS place FROM orders GROUP BY 1",
    "bins_groups_sets": "SELECT CAST(trunc(p_size / 10) * 10 AS BIGINT) AS bin, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' WHEN p_brand IN ('Brand#21', 'Brand#22') THEN 'second' ELSE 'Other' END AS brand_group, p_size IN (1, 2, 3) AS in_set, count(*) AS n FROM part GROUP BY ALL",
    "whatif_series": "SELECT v::DOUBLE AS value, v = 10 AS is_default FROM range(5, 21, 5) r(v)",
    "slicer_values": "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL",
    "slicer_selected": "SELECT o_orderstatus, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'many' END AS one, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE 'many' END AS several FROM orders GROUP BY 1",
    "param_bound_query": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
    "set_operations": "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT 'union_all' AS kind, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)",
}
