"""Queries over joins, models, calendars, validation, graphs, workbooks and progress, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fidelity as V
from ..operators import graph as G
from ..operators import model as M
from ..plans.discovery import recommendations
from ..sources import workbook as B
from ..sources.shared import shared_folder
from ..streaming import incremental as I  # noqa: E741
from .common import STAR, star, table


def join_star(spark, d):
    t = star(spark, d, ["lineitem", "orders", "customer", "nation", "region"])
    j = M.joined(t["lineitem"], (t["orders"], "l_orderkey", "o_orderkey"), (t["customer"], "o_custkey", "c_custkey"), (t["nation"], "c_nationkey", "n_nationkey"), (t["region"], "n_regionkey", "r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def join_blend(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("customers"))
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")
    return M.blended(c, s, ["nation"], {"suppliers": F.round(F.sum("s_acctbal"), 2)})


def join_m2m_safe(spark, d):
    o, e = table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "events").withColumnRenamed("user_id", "k")
    return M.many_to_many(o, e, "k", {"orders": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}, {"events": F.count("*"), "value": F.round(F.sum("value"), 2)})


def join_types(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 5000")
    per = lambda how: M.joined(n, (s, "n_nationkey", "s_nationkey"), how=how).agg(F.count("*").alias("n"), F.count("s_suppkey").alias("matched")).select(F.lit(how).alias("how"), "n", "matched")
    return per("left").unionByName(per("inner")).unionByName(per("full_outer"))


def rel_cardinality_inferred(spark, d):
    t = star(spark, d, ["customer", "orders", "lineitem", "nation"])
    pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("nation", "n_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "lineitem", "l_orderkey")]
    out = None
    for a, x, b, y in pairs:
        made = M.model_relationship(t[a], x, t[b], y).select(F.lit(x).alias("from"), F.lit(y).alias("to"), "cardinality", "filter_direction")
        out = made if out is None else out.unionByName(made)
    return out


def rel_ambiguity_prune(spark, d):
    """Of several relationships between two tables the first stays active; they come from the order of the items' columns."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("to"), F.col("l_linenumber").alias("seq"))
    return M.active_relationships(li.groupBy(F.col("l_orderkey").alias("from"), "to").agg(F.min("seq").alias("seq"))).groupBy("active").agg(F.count("*").alias("n"))


def star_classification(spark, d):
    return M.classified(star(spark, d)).select("table", "row_count", "column_count", "numeric_density", "classification", "confidence")


def likely_keys(spark, d):
    return M.likely_key(table(spark, d, "orders")).unionByName(M.likely_key(table(spark, d, "customer")))


def calendar_dim(spark, d):
    return M.calendar(spark, "2023-01-01", "2025-12-31").withColumn("Date", F.col("Date").cast("string")).drop("WeekNumber")


def calendar_fiscal(spark, d):
    return M.calendar(spark, "2024-01-01", "2025-12-31", 7).select(F.col("Date").cast("string").alias("Date"), "FiscalYear", "FiscalQuarter", "FiscalMonth")


def _truth(spark, d):
    return V.measured(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.sum("o_totalprice"))


def fidelity_pass(spark, d):
    """A measure against an equal one that is written another way."""
    other = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg((F.avg("o_totalprice") * F.count("o_totalprice")).alias("candidate_value"))
    return V.verdict(V.compare(_truth(spark, d), other, ["o_orderstatus", "o_orderpriority"])).drop("avg_delta", "max_delta")


def _wrong(spark, d):
    """Slices of a measure against one that is wrong in a way of its own for each priority."""
    p, x = F.col("o_orderpriority"), F.col("truth_value")
    factor = F.when(p.startswith("1"), 100.0).when(p.startswith("2"), 1.2).when(p.startswith("3"), 1.07).when(p.startswith("4"), 1.02).otherwise(1.00005)
    t = _truth(spark, d)
    bad = t.where("o_orderstatus <> 'P'").select("o_orderstatus", "o_orderpriority", F.when((F.col("o_orderstatus") == "O") & p.startswith("4"), F.lit(None)).otherwise(x * factor).alias("candidate_value"))
    return V.compare(t, bad, ["o_orderstatus", "o_orderpriority"])


def fidelity_taxonomy(spark, d):
    return _wrong(spark, d).select("o_orderstatus", "o_orderpriority", "passed", "error_category", F.round("relative_error", 6).alias("relative_error"))


def fidelity_stats(spark, d):
    return V.verdict(_wrong(spark, d)).select("slices", "passed_slices", "pass_rate", "overall_passed")


def fidelity_breakdown(spark, d):
    return V.error_breakdown(_wrong(spark, d))


def fidelity_failures(spark, d):
    return V.failure_analysis(_wrong(spark, d))


def fidelity_total(spark, d):
    o = table(spark, d, "orders")
    return V.compare(V.measured(o, [], F.count("*")), V.measured(o, [], F.count("o_custkey"), "candidate_value"), []).select("truth_value", "candidate_value", "passed", "error_category")


def confidence_buckets(spark, d):
    return V.confidence_buckets(table(spark, d, "events").where("value is not null").select(F.pmod(F.col("event_id"), F.lit(100)).alias("p")).select((F.col("p") / 100).alias("confidence")))


def latest_state(spark, d):
    return V.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def attempt_history(spark, d):
    return V.history(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").withColumn("attempt", F.col("attempt").cast("long"))


CALCS = [
    ("Revenue", "SUM([price])"), ("Cost", "SUM([cost])"), ("Profit", "[Revenue] - [Cost]"), ("Margin", "[Profit] / [Revenue]"), ("Run", "RUNNING_SUM([Profit])"), ("PerCust", "{FIXED [cust] : SUM([price])}"),
    ("Band", 'IF [price] > 10 THEN "hi" ELSE "lo" END'),
]


def _calcs(spark):
    return spark.createDataFrame(CALCS, "name string, formula string")


def graph_edges(spark, d):
    return G.edges(_calcs(spark))


def graph_levels(spark, d):
    return G.levels(_calcs(spark))


def graph_kinds(spark, d):
    f = F.col("formula")
    return _calcs(spark).select("name", G.calc_kind(f).alias("raw_kind"), G.granularity(f).alias("granularity"), G.lod_kind(f).alias("lod")).join(G.refined_kinds(_calcs(spark)), "name")


def model_recommendations(spark, d):
    return recommendations(_calcs(spark), spark.createDataFrame([(c,) for t in STAR for c in table(spark, d, t).columns], "column string"))


WORKBOOK = """<workbook><datasources><datasource name='ds'><connection><named-connections><named-connection caption='shop'><connection class='textscan' filename='shop.csv'/></named-connection></named-connections>
<relation type='join' join='left'><clause type='join'><expression op='='><expression op='[orders].[o_custkey]'/><expression op='[customer].[c_custkey]'/></expression></clause><relation type='table' name='orders' table='[Extract].[orders]'/><relation type='table' name='customer' table='[Extract].[customer]'/></relation></connection>
<relationships><relationship><expression op='='><expression op='[o_custkey]'/><expression op='[c_custkey (customer)]'/></expression><first-end-point object-id='orders'/><second-end-point object-id='customer'/></relationship></relationships>
<column name='[o_totalprice]' datatype='real' role='measure' type='quantitative'/><column name='[Calculation_1]' caption='Revenue' datatype='real' role='measure' type='quantitative'><calculation formula='SUM([o_totalprice])'/></column></datasource>
<datasource name='Parameters'><column name='[Parameter 1]' caption='Top N' datatype='integer' param-domain-type='list' value='10'><members><member value='5'/><member value='10'/><member value='20'/></members></column><column name='[Parameter 2]' caption='Rate' datatype='real' param-domain-type='range' value='0.1'><range min='0' max='1' granularity='0.1'/></column></datasource></datasources>
<worksheets><worksheet name='Sales'><table><rows>[ds].[sum:o_totalprice:qk]</rows><cols>[ds].[none:o_orderstatus:nk]</cols><panes><pane><encodings><color column='[ds].[none:o_orderpriority:nk]'/></encodings></pane></panes><view><filter class='categorical' column='[ds].[none:o_orderstatus:nk]' is-context='true'><groupfilter member='&quot;F&quot;'/></filter></view></table></worksheet></worksheets></workbook>"""


def _workbook(spark):
    """A small workbook, written as a file and read like any other."""
    path = f"{shared_folder(spark)}/workbook-{uuid.uuid4().hex}"
    spark.createDataFrame([(WORKBOOK.replace("\n", " "),)], "value string").coalesce(1).write.text(path)
    return B.workbook(spark, path)


def workbook_fields(spark, d):
    return _workbook(spark)["fields"]


def workbook_parameters(spark, d):
    return _workbook(spark)["parameters"]


def workbook_worksheets(spark, d):
    return _workbook(spark)["worksheets"]


def workbook_filters(spark, d):
    return _workbook(spark)["filters"]


def workbook_joined(spark, d):
    """The workbook's join over the tables, and the measure that it defines."""
    j = B.joined_tables(star(spark, d, ["orders", "customer"]), _workbook(spark)["joins"])
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("Revenue"))


_TREE = [
    ("inner", "orders", "o_custkey", "customer", "c_custkey"), ("left", "nation", "n_nationkey", "customer", "c_nationkey"), ("left", "nation", "n_regionkey", "region", "r_regionkey"), ("left", "customer", "c_nationkey", "region", "r_regionkey"), ("full", "sizes", "p_size", "nation", "n_nationkey"),
]


def workbook_join_tree(spark, d):
    """A tree of five joins: a left join whose left table comes second, a full join from the new side, and a table used twice."""
    joins = spark.createDataFrame(_TREE, "join_type string, left_table string, left_column string, right_table string, right_column string")
    tables = star(spark, d, ["orders", "customer", "nation", "region"]) | {"sizes": table(spark, d, "part").select("p_size").distinct()}
    j = B.joined_tables(tables, joins)
    return j.groupBy("r_name", F.col("r_name (region2)").alias("other")).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("orders"), F.count("p_size").alias("sizes"), F.countDistinct("n_nationkey").alias("nations"))


def progress_percent(spark, d):
    done = spark.createDataFrame([("LOADING", 1, 2), ("PROFILING", 2, 2), ("DETECTING", 1, 2), ("REPORTING", 5, 2)], "stage string, items long, total long")
    return I.progress(I.stages(spark), done)


def windowed_profile(spark, d):
    out = I.windowed_profile(table(spark, d, "events"), "ts", "event_type", "value", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "non_null", "min", "max", "mean")


def event_sessions(spark, d):
    out = I.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        join_star, join_blend, join_m2m_safe, join_types, rel_cardinality_inferred, rel_ambiguity_prune, star_classification, likely_keys, calendar_dim, calendar_fiscal, fidelity_pass, fidelity_taxonomy, fidelity_stats, fidelity_breakdown, fidelity_failures,
        fidelity_total, confidence_buckets, latest_state, attempt_history, graph_edges, graph_levels, graph_kinds, model_recommendations, workbook_fields, workbook_parameters, workbook_worksheets, workbook_filters, workbook_joined, workbook_join_tree, progress_percent,
        windowed_profile, event_sessions,
    )
}

_WRONG = """WITH t AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS x, left(o_orderpriority, 1) AS p FROM orders GROUP BY ALL),
s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' AND p = '4' THEN 0 ELSE x * CASE p WHEN '1' THEN 100.0 WHEN '2' THEN 1.2 WHEN '3' THEN 1.07 WHEN '4' THEN 1.02 ELSE 1.00005 END END AS y FROM t),
r AS (SELECT *, CASE WHEN y IS NULL THEN 1.0 ELSE abs(x - y) / x END AS e FROM s),
k AS (SELECT o_orderstatus, o_orderpriority, y IS NOT NULL AND e <= 1e-4 AS passed, CASE WHEN y IS NULL THEN 'MISSING_VALUE' WHEN e <= 1e-4 THEN 'PERFECT_MATCH' WHEN y = 0 THEN 'NULL_HANDLING' WHEN p = '1' THEN 'SCALE_ERROR' WHEN e > 0.1 THEN 'CONTEXT_SHIFT' WHEN e > 0.05 THEN 'GRAIN_MISMATCH' ELSE 'AGGREGATION_MISMATCH' END AS error_category, round(e, 6) AS relative_error FROM r) """
_NUMERIC = {"region": (2, 1), "nation": (3, 2), "customer": (5, 3), "supplier": (4, 3), "part": (6, 3), "orders": (6, 3), "lineitem": (11, 8), "events": (6, 3)}
_REL = "SELECT '{x}' AS \"from\", '{y}' AS \"to\", CASE WHEN u AND v THEN 'OneToOne' WHEN u THEN 'OneToMany' WHEN v THEN 'ManyToOne' ELSE 'ManyToMany' END AS cardinality, CASE WHEN NOT u AND NOT v THEN 'Both' ELSE 'Single' END AS filter_direction FROM (SELECT (SELECT count({x}) = count(DISTINCT {x}) FROM {a}) AS u, (SELECT count({y}) = count(DISTINCT {y}) FROM {b}) AS v)"
_ROWS = ", ".join("('" + n + "', '" + f.replace("'", "''") + "')" for n, f in CALCS)
_TABLE, _LOD, _AGG = "(?i)(RUNNING_[A-Z]+|WINDOW_[A-Z]+|RANK[A-Z_]*|LOOKUP|INDEX|FIRST|LAST|SIZE|TOTAL)[(]", "(?i)[{] *(FIXED|INCLUDE|EXCLUDE)", "(?i)(SUM|AVG|COUNT|COUNTD|MIN|MAX|MEDIAN)[(]"
_CALC_SQL = f"""WITH RECURSIVE c(name, formula) AS (VALUES {_ROWS}), e AS (SELECT name, unnest(regexp_extract_all(formula, '\\[([^\\]]+)\\]', 1)) AS source FROM c),
r AS (SELECT name, CASE WHEN regexp_matches(formula, '{_TABLE}') THEN 'TABLE_CALCULATION' WHEN regexp_matches(formula, '{_LOD}') THEN 'LOD_EXPRESSION' WHEN regexp_matches(formula, '{_AGG}') THEN 'MEASURE' ELSE 'COLUMN' END AS raw_kind,
CASE WHEN regexp_matches(formula, '{_TABLE}') THEN 'TABLE' WHEN regexp_matches(formula, '{_LOD}') OR regexp_matches(formula, '{_AGG}') THEN 'AGGREGATE' ELSE 'ROW' END AS granularity, nullif(upper(regexp_extract(formula, '{_LOD}', 1)), '') AS lod FROM c)"""
_DAYS = "SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY) s(d)"

ORACLE_SQL = {
    "join_star": "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "join_blend": "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, round(sum(c_acctbal), 2) AS customers FROM customer GROUP BY 1) LEFT JOIN (SELECT s_nationkey AS nation, round(sum(s_acctbal), 2) AS suppliers FROM supplier GROUP BY 1) USING (nation)",
    "join_m2m_safe": "SELECT k, orders, total, events, value FROM (SELECT o_custkey AS k, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) JOIN (SELECT user_id AS k, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1) USING (k)",
    "join_types": " UNION ALL ".join(f"SELECT '{h}' AS how, count(*) AS n, count(s_suppkey) AS matched FROM nation {j} JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey" for h, j in (("left", "LEFT"), ("inner", "INNER"), ("full_outer", "FULL"))),
    "rel_cardinality_inferred": " UNION ALL ".join(_REL.format(a=a, x=x, b=b, y=y) for a, x, b, y in (("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("nation", "n_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "lineitem", "l_orderkey"))),
    "rel_ambiguity_prune": "SELECT active, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY f, t ORDER BY seq) = 1 AS active FROM (SELECT l_orderkey AS f, t, min(l_linenumber) AS seq FROM (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS t FROM lineitem) GROUP BY 1, 2)) GROUP BY 1",
    "star_classification": "SELECT \"table\", row_count, column_count, numeric_density, CASE WHEN row_count > 100000 AND numeric_density > 0.5 THEN 'FACT' ELSE 'DIMENSION' END AS classification, CASE WHEN row_count > 100000 AND numeric_density > 0.5 THEN 95 WHEN row_count < 10000 AND numeric_density < 0.3 THEN 98 ELSE 70 END::BIGINT AS confidence FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count, {c}::BIGINT AS column_count, round({n}.0 / {c}, 4)::DOUBLE AS numeric_density FROM {t}" for t, (c, n) in _NUMERIC.items()) + ")",
    "likely_keys": "SELECT 'o_orderkey' AS \"column\", round(count(DISTINCT o_orderkey) * 1.0 / count(*), 4) AS cardinality FROM orders UNION ALL SELECT 'c_custkey', round(count(DISTINCT c_custkey) * 1.0 / count(*), 4) FROM customer",
    "calendar_dim": f"SELECT CAST(d AS VARCHAR) AS Date, year(d) AS Year, quarter(d) AS QuarterNumber, 'Q' || quarter(d) AS Quarter, month(d) AS MonthNumber, monthname(d) AS MonthName, left(monthname(d), 3) AS MonthShort, strftime(d, '%Y-%m') AS YearMonth, day(d) AS Day, dayofyear(d) AS DayOfYear, isodow(d) AS WeekdayNumber, dayname(d) AS Weekday, isodow(d) >= 6 AS IsWeekend FROM ({_DAYS.format(a='2023-01-01', b='2025-12-31')})",
    "calendar_fiscal": f"SELECT CAST(d AS VARCHAR) AS Date, year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS FiscalYear, CAST(floor(((month(d) + 5) % 12) / 3) AS BIGINT) + 1 AS FiscalQuarter, (month(d) + 5) % 12 + 1 AS FiscalMonth FROM ({_DAYS.format(a='2024-01-01', b='2025-12-31')})",
    "fidelity_pass": "SELECT count(*) AS slices, count(*) AS passed_slices, 1.0::DOUBLE AS pass_rate, true AS overall_passed FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)",
    "fidelity_taxonomy": _WRONG + "SELECT * FROM k",
    "fidelity_stats": _WRONG + "SELECT count(*) AS slices, count(*) FILTER (passed) AS passed_slices, round(count(*) FILTER (passed) * 1.0 / count(*), 6) AS pass_rate, bool_and(passed) AS overall_passed FROM k",
    "fidelity_breakdown": _WRONG + "SELECT error_category, count(*) AS n FROM k WHERE NOT passed GROUP BY 1",
    "fidelity_failures": _WRONG + ", g AS (SELECT error_category, count(*) AS n FROM k WHERE NOT passed GROUP BY 1) SELECT arg_max(error_category, (n, error_category)) AS category, CAST(sum(n) AS BIGINT) AS failed, max(n) = sum(n) AS all_alike, CASE WHEN max(n) = sum(n) THEN 0.9 WHEN max(n) / sum(n) > 0.5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM g",
    "fidelity_total": "SELECT count(*)::DOUBLE AS truth_value, count(o_custkey)::DOUBLE AS candidate_value, true AS passed, 'PERFECT_MATCH' AS error_category FROM orders",
    "confidence_buckets": "SELECT count(*) FILTER (p >= 90) AS automatic, count(*) FILTER (p >= 70 AND p < 90) AS manual, count(*) FILTER (p < 70) AS complex, round(count(*) FILTER (p >= 90) * 1.0 / count(*), 6) AS rate FROM (SELECT event_id % 100 AS p FROM events WHERE value IS NOT NULL)",
    "latest_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "attempt_history": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events",
    "graph_edges": "SELECT * FROM (VALUES ('price', 'Revenue'), ('cost', 'Cost'), ('Revenue', 'Profit'), ('Cost', 'Profit'), ('Profit', 'Margin'), ('Revenue', 'Margin'), ('Profit', 'Run'), ('cust', 'PerCust'), ('price', 'PerCust'), ('price', 'Band')) v(source, target)",
    "graph_levels": "WITH RECURSIVE e(s, t) AS (VALUES ('price', 'Revenue'), ('cost', 'Cost'), ('Revenue', 'Profit'), ('Cost', 'Profit'), ('Profit', 'Margin'), ('Revenue', 'Margin'), ('Profit', 'Run'), ('cust', 'PerCust'), ('price', 'PerCust'), ('price', 'Band')), r(name, level) AS (SELECT DISTINCT s, 0::BIGINT FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT t, level + 1 FROM r JOIN e ON s = name) SELECT name, max(level) AS level FROM r GROUP BY 1",
    "workbook_join_tree": """SELECT r_name, other, count(*) AS n, count(o_orderkey) AS orders, count(p_size) AS sizes, count(DISTINCT n_nationkey) AS nations
FROM (SELECT DISTINCT p_size FROM part) FULL JOIN (SELECT n_nationkey, o_orderkey, r.r_name, s.r_name AS other FROM nation LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON n_nationkey = c_nationkey LEFT JOIN region r ON n_regionkey = r.r_regionkey LEFT JOIN region s ON c_nationkey = s.r_regionkey) ON p_size = n_nationkey GROUP BY 1, 2""",
    "workbook_joined": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS Revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "progress_percent": "SELECT * FROM (VALUES ('LOADING', 1::BIGINT, 2::BIGINT, 5.0::DOUBLE), ('PROFILING', 2, 2, 35.0), ('DETECTING', 1, 2, 50.0), ('REPORTING', 5, 2, 100.0)) v(stage, items, total, percent)",
    "windowed_profile": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(value) AS non_null, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "event_sessions": "WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m), g AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1",
    "graph_kinds": _CALC_SQL + """, m(name) AS (SELECT name FROM r WHERE raw_kind <> 'COLUMN' UNION SELECT e.name FROM m JOIN e ON e.source = m.name JOIN r ON r.name = e.name AND r.raw_kind = 'COLUMN')
SELECT name, raw_kind, granularity, lod, CASE WHEN raw_kind = 'COLUMN' AND name IN (SELECT name FROM m) THEN 'MEASURE' ELSE raw_kind END AS kind FROM r""",
    "model_recommendations": _CALC_SQL + " SELECT (SELECT bool_or(lod IS NOT NULL) FROM r) AS has_lod, (SELECT bool_or(granularity = 'TABLE') FROM r) AS needs_row_index, (SELECT bool_or(regexp_matches(lower(c), 'date|_dt$|time')) FROM (" + " UNION ALL ".join(f"SELECT column_name AS c FROM (DESCRIBE {t})" for t in STAR) + ")) AS needs_date_table",
}
