"""Queries over profiles, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import tables as S
from .common import STAR, star, table


def scan_limit_ordered(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


def row_counts(spark, d):
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in star(spark, d).items()])


def schema_types(spark, d):
    return S.columns_of(table(spark, d, "customer"), "customer").select("table", F.col("ordinal").cast("long").alias("ordinal"), "column", "generic_type")


def profile_nulls(spark, d):
    df = table(spark, d, "orders").withColumns({"o_custkey": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")), "o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus"))})
    return P.nulls(df, ["o_orderkey", "o_custkey", "o_orderstatus"])


def profile_uniqueness(spark, d):
    return P.uniqueness(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def profile_numeric_stats(spark, d):
    return P.numeric_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], exact_median=True).select("column", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


def profile_string_lengths(spark, d):
    return P.text_lengths(table(spark, d, "part"), ["p_name", "p_brand", "p_type"]).withColumn("avg_length", F.round("avg_length", 6))


def profile_date_range(spark, d):
    return P.date_range(table(spark, d, "orders"), ["o_orderdate"]).withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date")})


def profile_topk_values(spark, d):
    return P.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def profile_sequential(spark, d):
    return P.sequential(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])


def profile_case_pattern(spark, d):
    df = table(spark, d, "customer").select(F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"), F.initcap("c_mktsegment").alias("title"), F.concat(F.lower("c_mktsegment"), F.lit("X")).alias("mixed"))
    return P.case_pattern(df, df.columns)


def profile_prefix(spark, d):
    df = table(spark, d, "customer").select("c_name", F.concat(F.lit("CUST-"), "c_custkey").alias("code"), "c_mktsegment")
    return P.common_prefix(df, ["c_name", "code", "c_mktsegment"])


def profile_shape(spark, d):
    df = table(spark, d, "customer").select(F.concat(F.lit("AB-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("code"), "c_mktsegment")
    return P.shapes(df, ["code", "c_mktsegment"])


def profile_date_format(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    df = table(spark, d, "orders").select(f("yyyy-MM-dd").alias("iso"), f("MM/dd/yyyy").alias("us"), f("dd.MM.yyyy").alias("dots"), F.col("o_orderstatus").alias("none"))
    return P.date_format(df, df.columns)


def profile_key_flags(spark, d):
    df = table(spark, d, "orders")
    made = P.nulls(df, ["o_orderkey", "o_custkey", "o_orderstatus"]).join(P.uniqueness(df, ["o_orderkey", "o_custkey", "o_orderstatus"]), "column")
    return P.key_flags(made).select("column", "is_unique", "is_mostly_unique", "primary_key_candidate", "foreign_key_candidate")


def type_inference(spark, d):
    df = table(spark, d, "part").select(F.col("p_size").cast("string").alias("text_int"), F.col("p_retailprice").cast("string").alias("text_float"), "p_retailprice", "p_partkey", "p_name", F.lit("2024-01-31").alias("text_date"), F.lit(None).cast("string").alias("nothing"), (F.col("p_size") > 5).alias("flag"))
    return P.inferred_types(df, df.columns)


def composite_keys(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = P.dealt(li, li.count(), "l_orderkey").withColumn("l_slot", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return P.composite_keys(li, ["l_orderkey", "l_slot", "l_suppkey"]).select(F.array_join("columns", ",").alias("columns"), F.col("size").cast("long").alias("size"))


def cross_table_columns(spark, d):
    o, li = table(spark, d, "orders").columns, table(spark, d, "lineitem").columns
    made = P.shared_names({"orders": o, "lineitem": [c.replace("l_", "o_") for c in li], "upper": [c.upper() for c in o]})
    return spark.createDataFrame([(n, t, c) for n, at in made.items() for t, c in at], "normalized string, table string, column string")


def duplicate_rows(spark, d):
    return P.duplicate_rows(table(spark, d, "documents"), ["text", "lang"])


def data_quality_status(spark, d):
    made = [P.duplicate_rows(df).select(F.lit(t).alias("table"), "row_count", "duplicate_rate", "status") for t, df in star(spark, d).items()]
    return reduce(DataFrame.unionByName, made)


def test_slices(spark, d):
    return P.slices(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 10)


def json_props_profile(spark, d):
    df = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type")
    return P.top_values(df, ["k", "event_type"], 5)


def id_like_columns(spark, d):
    return P.id_like(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def _wide_keys(spark, d):
    """Orders with keys beyond 2**53 as bigint, as decimal(38,0), and far beyond any long."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select((key + F.lit(1 << 60)).alias("big"), (key + F.lit(1 << 60)).cast("decimal(38,0)").alias("same"), (key.cast("decimal(38,0)") + F.lit("123456789012345678901234567890").cast("decimal(38,0)")).cast("decimal(38,0)").alias("huge"))


def profile_wide_keys(spark, d):
    """Exact counts, key flags and sequences of numbers that doubles can't tell apart."""
    df = _wide_keys(spark, d)
    p = P.column_profiles(df, "wide").select("column", "row_count", "unique_count", "unique_percent", "is_unique", "primary_key_candidate", "is_sequential")
    return p.join(P.top_values(df, k=1).select("column", F.col("value").alias("least_value")), "column")


_ORDERS_NULLS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders"


def _each(columns: list[str], sql: str) -> str:
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


_UNIQUE = "SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count({c}), 4) AS unique_percent, count({c}) - count(DISTINCT {c}) AS duplicate_count, round(count(DISTINCT {c}) * 1.0 / count(*), 4) AS cardinality FROM orders"
_TOP = "SELECT \"column\", \"rank\", value, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS \"rank\" FROM (SELECT \"column\", value, count(*) AS n FROM ({src}) WHERE value IS NOT NULL GROUP BY ALL)) WHERE \"rank\" <= {k}"
_SEQ = "SELECT '{c}' AS \"column\", (SELECT count({c}) - 1 FROM orders) AS steps, count(*) FILTER (v - p = 1) AS unit_steps, count(*) FILTER (v - p = 1) > 0.95 * (SELECT count({c}) - 1 FROM orders) AS is_sequential FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM (SELECT DISTINCT {c} AS v FROM orders))"

QUERIES = {
    f.__name__: f
    for f in (
        scan_limit_ordered, row_counts, schema_types, profile_nulls, profile_uniqueness, profile_numeric_stats, profile_string_lengths, profile_date_range, profile_topk_values, profile_sequential, profile_case_pattern, profile_prefix, profile_shape,
        profile_date_format, profile_key_flags, type_inference, composite_keys, cross_table_columns, duplicate_rows, data_quality_status, test_slices, json_props_profile, id_like_columns, profile_wide_keys,
    )
}

_WIDE = {"big": "(o_orderkey + 1152921504606846976)", "same": "(o_orderkey + 1152921504606846976)", "huge": "(o_orderkey + 123456789012345678901234567890)"}
_WIDE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS row_count, count(DISTINCT v) AS unique_count, round(count(DISTINCT v) * 100.0 / count(*), 4) AS unique_percent, count(DISTINCT v) * 100.0 / count(*) >= 99.9 AS is_unique, count(DISTINCT v) * 100.0 / count(*) >= 99.9 AND count(DISTINCT v) >= 10 AS primary_key_candidate,
    (SELECT count(*) FILTER (v - p = 1) FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM (SELECT DISTINCT {x} AS v FROM orders))) > 0.95 * (count(*) - 1) AS is_sequential,
    (SELECT s FROM (SELECT CAST({x} AS VARCHAR) AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, s LIMIT 1)) AS least_value FROM (SELECT {x} AS v FROM orders)"""
    for c, x in _WIDE.items()
)

ORACLE_SQL = {
    "profile_wide_keys": _WIDE_SQL,
    "scan_limit_ordered": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in STAR),
    "schema_types": "SELECT 'customer' AS \"table\", row_number() OVER () - 1 AS ordinal, column_name AS \"column\", CASE WHEN regexp_matches(column_type, 'INT|DOUBLE|FLOAT|DECIMAL') THEN 'NUMERIC' WHEN column_type = 'VARCHAR' THEN 'STRING' WHEN regexp_matches(column_type, 'DATE|TIMESTAMP') THEN 'DATETIME' WHEN column_type = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'UNKNOWN' END AS generic_type FROM (DESCRIBE customer)",
    "profile_nulls": f"WITH t AS ({_ORDERS_NULLS}) " + _each(["o_orderkey", "o_custkey", "o_orderstatus"], "SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_percent, count(*) FILTER (CAST({c} AS VARCHAR) = '') AS empty_count FROM t"),
    "profile_uniqueness": _each(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], _UNIQUE),
    "profile_numeric_stats": _each(["l_quantity", "l_extendedprice", "l_discount"], "SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM lineitem"),
    "profile_string_lengths": _each(["p_name", "p_brand", "p_type"], "SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length FROM part"),
    "profile_date_range": "SELECT 'o_orderdate' AS \"column\", CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS min_date, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS max_date, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS days FROM orders",
    "profile_topk_values": _TOP.replace("{k}", "20").replace("{src}", _each(["o_orderstatus", "o_orderpriority", "o_custkey"], "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM orders")),
    "profile_sequential": _each(["o_orderkey", "o_custkey"], _SEQ),
    "profile_case_pattern": "WITH t AS (SELECT upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, lower(c_mktsegment) || 'X' AS mixed FROM customer) " + _each(["up", "low", "title", "mixed"], "SELECT '{c}' AS \"column\", CASE WHEN bool_and({c} = upper({c})) THEN 'UPPER' WHEN bool_and({c} = lower({c})) THEN 'LOWER' WHEN bool_and(NOT regexp_matches({c}, '(^|[^A-Za-z])[a-z]') AND NOT regexp_matches({c}, '[A-Za-z][A-Z]')) THEN 'TITLE' ELSE 'MIXED' END AS case_pattern FROM t"),
    "profile_prefix": "WITH v AS (SELECT c_name AS value, 'c_name' AS \"column\" FROM customer UNION ALL SELECT 'CUST-' || c_custkey, 'code' FROM customer UNION ALL SELECT c_mktsegment, 'c_mktsegment' FROM customer), n AS (SELECT \"column\", count(*) AS total FROM v GROUP BY 1), k AS (SELECT \"column\", i, left(value, i) AS p, count(*) AS c FROM v, range(1, 10) r(i) WHERE length(value) >= i GROUP BY ALL), b AS (SELECT k.\"column\", arg_max(p, i) AS prefix FROM k JOIN n USING (\"column\") WHERE c > 0.9 * total GROUP BY 1) SELECT n.\"column\", coalesce(prefix, '') AS prefix, prefix IS NOT NULL AS has_prefix FROM n LEFT JOIN b USING (\"column\")",
    "profile_shape": "WITH t AS (SELECT 'AB-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_mktsegment FROM customer), v AS (SELECT 'code' AS \"column\", code AS v FROM t UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM t), n AS (SELECT \"column\", regexp_replace(regexp_replace(regexp_replace(v, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT \"column\", arg_max(shape, (n, shape)) AS shape, max(n) / sum(n) AS part FROM n GROUP BY 1) SELECT \"column\", CASE WHEN part > 0.8 THEN shape END AS shape, round(part, 6) AS share FROM b",
    "profile_date_format": "WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d.%m.%Y') AS dots, o_orderstatus AS none FROM orders) " + _each(["iso", "us", "dots", "none"], "SELECT '{c}' AS \"column\", CASE WHEN avg(CAST(regexp_full_match({c}, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS INT)) > 0.9 THEN '%Y-%m-%d' WHEN avg(CAST(regexp_full_match({c}, '[0-9]{2}/[0-9]{2}/[0-9]{4}') AS INT)) > 0.9 THEN '%m/%d/%Y' WHEN avg(CAST(regexp_full_match({c}, '[0-9]{2}[.][0-9]{2}[.][0-9]{4}') AS INT)) > 0.9 THEN '%d.%m.%Y' END AS date_format FROM t"),
    "profile_key_flags": _each(["o_orderkey", "o_custkey", "o_orderstatus"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) * 100.0 / count({c}) >= 99.9 AS is_unique, count(DISTINCT {c}) * 100.0 / count({c}) >= 0.95 AS is_mostly_unique, count(DISTINCT {c}) * 100.0 / count({c}) >= 99.9 AND count(DISTINCT {c}) >= 10 AND count({c}) > 0.99 * count(*) AS primary_key_candidate, round(count(DISTINCT {c}) * 100.0 / count({c}), 4) >= 0.7 AND count(DISTINCT {c}) >= 10 AS foreign_key_candidate FROM orders"),
    "type_inference": "WITH t AS (SELECT CAST(p_size AS VARCHAR) AS text_int, CAST(p_retailprice AS VARCHAR) AS text_float, CAST(p_retailprice AS VARCHAR) AS p_retailprice, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, '2024-01-31' AS text_date, CAST(NULL AS VARCHAR) AS nothing FROM part) " + _each(["text_int", "text_float", "p_retailprice", "p_partkey", "p_name", "text_date", "nothing"], "SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'unknown' WHEN bool_and(regexp_matches({c}, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AND TRY_CAST({c} AS DATE) IS NOT NULL) THEN 'datetime' WHEN count(TRY_CAST({c} AS DOUBLE)) > 0.9 * count({c}) THEN CASE WHEN bool_and(TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE))) THEN 'int' ELSE 'float' END ELSE 'string' END AS data_type FROM t") + " UNION ALL SELECT 'flag', lower(any_value(typeof(p_size > 5))) FROM part",
    "composite_keys": "WITH li AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_slot FROM lineitem), p AS (SELECT 'l_orderkey,l_slot' AS columns, 2::BIGINT AS size, count(*) = count(DISTINCT (l_orderkey, l_slot)) AS ok FROM li UNION ALL SELECT 'l_orderkey,l_suppkey', 2, count(*) = count(DISTINCT (l_orderkey, l_suppkey)) FROM li UNION ALL SELECT 'l_slot,l_suppkey', 2, count(*) = count(DISTINCT (l_slot, l_suppkey)) FROM li) SELECT columns, size FROM p WHERE ok",
    "cross_table_columns": "WITH c AS (SELECT 'lineitem' AS \"table\", replace(column_name, 'l_', 'o_') AS c FROM (DESCRIBE lineitem) UNION ALL SELECT 'orders', column_name FROM (DESCRIBE orders) UNION ALL SELECT 'upper', upper(column_name) FROM (DESCRIBE orders)), n AS (SELECT *, lower(regexp_replace(c, '[^A-Za-z0-9]', '', 'g')) AS normalized FROM c) SELECT normalized, \"table\", c AS \"column\" FROM n WHERE normalized IN (SELECT normalized FROM n GROUP BY 1 HAVING count(DISTINCT \"table\") > 1)",
    "duplicate_rows": "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang) SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_count, round((sum(n) - count(*)) * 100.0 / sum(n), 4) AS duplicate_rate, CASE WHEN round((sum(n) - count(*)) * 100.0 / sum(n), 4) < 1 THEN 'good' ELSE 'warning' END AS status FROM g",
    "data_quality_status": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST((SELECT count(*) FROM {t}) AS BIGINT) AS row_count, round(((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) * 100.0 / (SELECT count(*) FROM {t}), 4) AS duplicate_rate, CASE WHEN ((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) * 100.0 / (SELECT count(*) FROM {t}) < 1 THEN 'good' ELSE 'warning' END AS status" for t in STAR),
    "test_slices": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1, 2 LIMIT 10",
    "json_props_profile": _TOP.replace("{k}", "5").replace("{src}", "SELECT 'k' AS \"column\", json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT 'event_type', event_type FROM events"),
    "id_like_columns": "WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer) " + _each(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "SELECT '{c}' AS \"column\", regexp_matches('{c}', 'id|key|code|number|_no|_num') OR avg(CAST(regexp_matches({c}, '^[A-Z]{2,4}[0-9]+$') AS INT)) > 0.8 OR avg(CAST(regexp_matches({c}, '^[0-9]{4,}$') AS INT)) > 0.8 OR avg(CAST(regexp_matches({c}, '^[A-Z]-[0-9]+$') AS INT)) > 0.8 AS looks_like_id FROM t"),
}
