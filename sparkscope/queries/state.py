"""Queries over state tables, patterns, further profiles and measures, and their SQL. Jobs are customers, conversions their orders, validations the orders' lines, corrections the events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import fidelity as V
from ..operators import filters as X
from ..operators import model as M
from ..operators import patterns as L
from ..operators import profile as P
from ..operators import relationships as R
from ..operators import state as S
from ..sources.shared import fresh_folder
from ..sources.state_table import StateTable
from .common import STAR, star, table


def state_look_up(spark, d):
    return S.look_up(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_orderkey").select("o_orderkey", "o_custkey")


def state_exists(spark, d):
    o = table(spark, d, "orders")
    return S.exists(o, {"o_orderstatus": "F"}).select(F.lit("F").alias("status"), "found").unionByName(S.exists(o, {"o_orderstatus": "X"}).select(F.lit("X").alias("status"), "found"))


def state_joins(spark, d):
    """The five joins of state tables: rows of each and a sum over the parent's column."""
    c, o, li, e, s = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "events", "supplier"))
    calls = [
        ("calculations", S.with_parent(o.withColumnRenamed("o_custkey", "k"), c.withColumnRenamed("c_custkey", "k"), "k", ["c_nationkey"]), "c_nationkey"),
        ("validations", S.with_parent(li.withColumnRenamed("l_orderkey", "k"), o.withColumnRenamed("o_orderkey", "k"), "k", ["o_custkey"]), "o_custkey"),
        ("passed_validations", S.with_parent(li.where("l_returnflag = 'A'").withColumnRenamed("l_orderkey", "k"), o.withColumnRenamed("o_orderkey", "k"), "k", ["o_custkey"]), "o_custkey"),
        ("corrections", S.with_parent(e.withColumnRenamed("user_id", "k"), c.withColumnRenamed("c_custkey", "k"), "k", ["c_nationkey"]), "c_nationkey"),
        ("slices", S.with_parent(li.withColumnRenamed("l_suppkey", "k"), s.withColumnRenamed("s_suppkey", "k"), "k", ["s_nationkey"]), "s_nationkey"),
    ]
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.sum(x).cast("long").alias("total")) for name, df, x in calls])


def state_grouped_slices(spark, d):
    g = S.grouped(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"])
    return g.select("l_orderkey", "n", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("items"))


def _changes(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.element_at(F.array(*map(F.lit, ["RUNNING", "FAILED", "DONE"])), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("stage"))


def state_current(spark, d):
    """Each job's columns after all its changes, and when it began and ended."""
    return S.current(_changes(spark, d), "user_id", "event_id", "status", "RUNNING", ["DONE", "FAILED"])


def state_cascade(spark, d):
    """Lines that are left when the orders of some customers have been deleted."""
    left = table(spark, d, "orders").where("o_custkey % 10 <> 3").withColumnRenamed("o_orderkey", "l_orderkey")
    return S.without_orphans(table(spark, d, "lineitem"), left, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def state_clean_up(spark, d):
    o = table(spark, d, "orders")
    kept = S.kept_after(o, "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"), 30, F.col("o_orderstatus").isin("F", "O"))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def state_merged(spark, d):
    """Customers as jobs, changed by their events in three merges, of which the second comes again: the last version, and how many rows each version has."""
    jobs = StateTable(spark, fresh_folder(spark, "state"), ["id"], 16)
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("at"), F.lit("new").alias("status"), F.col("c_acctbal").alias("value"))
    jobs.merge(base, "at")
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), ((F.col("event_id") % 11) == 5).alias("gone"))
    half = e.agg(F.max("at")).first()[0] // 2
    for part in (e.where(F.col("at") <= half), e.where(F.col("at") > half), e.where(F.col("at") <= half)):
        jobs.merge(part, "at", "gone", partial=True)
    sizes = [jobs.read(n).agg(F.lit(-n).cast("long").alias("id"), F.count("*").alias("at")).withColumns({"status": F.lit("version"), "value": F.lit(None).cast("double")}) for n in jobs.versions()]
    return reduce(DataFrame.unionByName, [jobs.read(), *sizes])


def state_of_status(spark, d):
    return S.of_status(table(spark, d, "orders"), "o_orderstatus", ["P", "F"])


def state_flagged(spark, d):
    return S.flagged(table(spark, d, "nation"), "n_nationkey", [1, 3, 5]).select("n_nationkey", "deleted")


def state_recent(spark, d):
    return S.recent(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def state_report(spark, d):
    o = table(spark, d, "orders").select(((F.col("o_orderkey") % 100) / 100).alias("c"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "Passed").alias("s"))
    return o.groupBy(S.reported_status(F.col("c"), F.col("s")).alias("status")).agg(F.count("*").alias("n"))


def first_seen_lists(spark, d):
    """Kinds of each user's events, each once, in the order they first came."""
    return S.first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("kinds"))


def state_cascade_tree(spark, d):
    """What is left of five tables when some customers and some orders go: lines with their orders, orders and events with their customers; lines of deleted parts lose the part."""
    tables = star(spark, d, ["lineitem", "orders", "customer", "events", "part"])
    references = [S.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"), S.Reference("orders", "o_custkey", "customer", "c_custkey"), S.Reference("events", "user_id", "customer", "c_custkey"), S.Reference("lineitem", "l_partkey", "part", "p_partkey", "set null")]
    left = S.cascade(tables, references, {"customer": F.col("c_mktsegment") == "BUILDING", "orders": F.col("o_orderpriority") == "5-LOW", "part": F.col("p_size") > 40})
    keys = {"lineitem": "l_partkey", "orders": "o_custkey", "customer": "c_custkey", "events": "user_id", "part": "p_partkey"}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.count(keys[t]).alias("named"), F.sum(keys[t]).cast("long").alias("total")) for t, df in left.items()])


def _patterns(spark, d):
    """Parts as patterns."""
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.array_distinct(F.concat(F.array("p_brand"), F.split("p_type", " "))).alias("tags"), F.when(F.col("p_size") < 15, "easy").when(F.col("p_size") < 35, "medium").otherwise("hard").alias("difficulty"),
        F.col("p_name").alias("formula"), F.col("p_type").alias("target"), F.lit(None).cast("string").alias("notes"),
    )


def patterns_summary(spark, d):
    return L.summary(_patterns(spark, d))


def patterns_found(spark, d):
    """Patterns by id, by a tag, by two tags, by difficulty and by words: the number of each."""
    p = _patterns(spark, d)
    tag = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    found = {"id": L.by_id(p, "7"), "tag": L.by_tags(p, [tag]), "difficulty": L.by_difficulty(p, "Hard"), "words": L.search(p, "A")}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("by"), F.count("*").alias("n")) for k, df in found.items()])


def pattern_suggestions(spark, d):
    p = _patterns(spark, d)
    return L.suggestions(p, p.where("id = '7'").first()["formula"], 3)


def profile_numeric_pattern(spark, d):
    o = P.numeric_pattern(P.column_profiles(table(spark, d, "orders"), "orders").unionByName(P.column_profiles(table(spark, d, "part"), "part")))
    return o.select("table", "column", "numeric_pattern", "key_kind")


def sample_values(spark, d):
    return P.samples(table(spark, d, "customer").select("c_name", "c_mktsegment"), k=5).select("column", F.array_join("samples", ",").alias("samples"))


def column_preview(spark, d):
    df = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderstatus")
    return P.preview(df, "orders").select("table", "column", "data_type", "null_count", "unique_count", F.array_join("samples", ",").alias("samples"))


def table_summary(spark, d):
    p = R.profiles_of(star(spark, d), statistics=False)
    return P.table_summary(p).select("table", "row_count", F.col("column_count"), "null_cells", "columns")


def column_profile_all(spark, d):
    """The whole profile of the orders: nulls, distinct values, type, statistics, sequence."""
    p = P.column_profiles(table(spark, d, "orders"), "orders")
    return p.select("column", F.col("ordinal").cast("long").alias("ordinal"), "row_count", "null_count", "unique_count", "duplicate_count", "unique_percent", "data_type", "min", "max", F.round("mean", 6).alias("mean"), "is_sequential", "primary_key_candidate")


def json_rows(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("event_id") * 0.5).alias("x"), "ts", "event_type")
    j = P.json_rows(df).select("json")
    get = lambda k: F.get_json_object("json", f"$.{k}")
    return j.select(get("event_id").cast("long").alias("event_id"), get("x").cast("double").alias("x"), get("ts").alias("ts"), get("event_type").alias("event_type"))


def name_hints(spark, d):
    cols = spark.createDataFrame([(t, c) for t in STAR for c in table(spark, d, t).columns], "table string, column string")
    return P.name_hints(cols).select("table", "column", F.array_join("words", " ").alias("words"), "subject", "looks_like_id", "looks_like_name", "looks_like_phone")


def agg_sql_text(spark, d):
    """Measures given as SQL text; one that still names a calculation gives no rows."""
    o = table(spark, d, "orders")
    found = V.measured_text(o, ["o_orderstatus"], "round(sum(o_totalprice) / count(DISTINCT o_custkey), 4)")
    return found.unionByName(V.measured_text(o, ["o_orderstatus"], "sum(Calculation_12)"))


def fidelity_context_nulls(spark, d):
    """Slices with nulls in kept and other dimensions."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), "o_totalprice")
    return V.in_context(o, ["status", "priority"], ["status"], F.round(F.sum("o_totalprice"), 2))


def fidelity_context(spark, d):
    """A measure by status and priority in the context of the status alone."""
    return V.in_context(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], F.round(F.sum("o_totalprice"), 2))


def join_calendar(spark, d):
    days = M.calendar(spark, "1992-01-01", "2026-12-31")
    j = M.with_calendar(table(spark, d, "orders"), "o_orderdate", days)
    return j.groupBy("Year", "IsWeekend").agg(F.count("*").alias("n"))


def model_totals(spark, d):
    return M.totals(M.classified(star(spark, d)))


def business_summary(spark, d):
    t = star(spark, d, ["customer", "orders", "nation", "events"])
    renamed = {"customer": t["customer"].withColumnRenamed("c_custkey", "cust_id"), "orders": t["orders"].withColumnRenamed("o_custkey", "cust_id"), "nation": t["nation"], "events": t["events"]}
    return R.business_summary(R.profiles_of(renamed), R.discover(renamed))


def slice_keys(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.groupBy(N.slice_key(["status", "o_orderpriority"]).alias("slice")).agg(F.count("*").alias("n"))


def number_formats(spark, d):
    f = F.element_at(F.array(*map(F.lit, ["#,##0", "0.0%", "0,,M", "0.00", "*x"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", f.alias("raw")).select("n_nationkey", "raw", N.number_format(F.col("raw")).alias("format"))


def caption_formulas(spark, d):
    """Formulas with ids resolved; what is left unresolved is marked."""
    f = F.concat(F.lit("SUM([Calculation_"), F.col("n_regionkey").cast("string"), F.lit("]) / [x (orders)] + [y (nation)]"))
    df = table(spark, d, "nation").select("n_nationkey", N.with_captions(f, {"Calculation_0": "Revenue", "Calculation_1": "Cost"}).alias("formula"))
    tables = F.array_join(F.transform(N.field_tables(F.col("formula")), lambda x: F.concat_ws(".", x["table"], x["field"])), ",")
    return df.select("n_nationkey", "formula", N.unresolved(F.col("formula")).alias("unresolved"), tables.alias("fields"))


def filter_kinds(spark, d):
    c = F.element_at(F.array(*map(F.lit, ["categorical", "quantitative", "relative-date", "top", "other"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", X.filter_kind(c).alias("kind"))


def rel_formats(spark, d):
    """Columns of like names that meet only after a change of case or of a prefix, through the whole cascade."""
    c = table(spark, d, "customer")
    a = c.select(F.concat(F.lit("Seg"), F.col("c_custkey")).alias("segment_code"), F.concat(F.lit("CUST-"), F.col("c_custkey")).alias("customer_ref"), (F.col("c_custkey") * 2).cast("string").alias("other"))
    b = c.where("c_custkey % 4 <> 0").select(F.upper(F.concat(F.lit("Seg"), F.col("c_custkey"))).alias("segment_code_b"), F.col("c_custkey").cast("string").alias("customer_ref_b"), F.lit("x").alias("nothing"))
    return R.discover({"a": a, "b": b}).where("relationship_type = 'FORMAT_MISMATCH'").select("source_column", "target_column", "detection_method", "transformation", "confidence_score", "overlap_percent", "exact_matches")


def rel_high_overlap(spark, d):
    """Columns of unlike names with common values, as a validator confirms them."""
    a, b = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("home"))
    found = R.discover({"a": a, "b": b}, overlap_validator=lambda p: p.withColumn("confidence", F.when(F.col("column2") == "home", 90).otherwise(10)))
    return found.where("detection_method = 'HIGH_OVERLAP_VALIDATION'").select("source_column", "target_column", "confidence_level", "confidence_score", "exact_matches", "overlap_percent")


QUERIES = {
    f.__name__: f
    for f in (
        state_look_up, state_exists, state_joins, state_grouped_slices, state_current, state_cascade, state_clean_up, state_of_status, state_flagged, state_recent, state_report, first_seen_lists, patterns_summary, patterns_found, pattern_suggestions,
        profile_numeric_pattern, sample_values, column_preview, table_summary, column_profile_all, json_rows, name_hints, agg_sql_text, fidelity_context, fidelity_context_nulls, state_cascade_tree, state_merged, join_calendar, model_totals, business_summary, slice_keys, number_formats, caption_formulas, filter_kinds,
        rel_formats, rel_high_overlap,
    )
}

_COLS = {t: f"(SELECT '{t}' AS \"table\", column_name AS c, row_number() OVER () AS place FROM (DESCRIBE {t}))" for t in STAR}
_ALL = " UNION ALL ".join(f"SELECT * FROM {q}" for q in _COLS.values())
_CHANGES = "SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN event_id % 4 = 0 THEN event_type END AS stage FROM events"
_PATTERNS = "SELECT CAST(p_partkey AS VARCHAR) AS id, list_distinct([p_brand] || string_split(p_type, ' ')) AS tags, CASE WHEN p_size < 15 THEN 'easy' WHEN p_size < 35 THEN 'medium' ELSE 'hard' END AS difficulty, p_name || chr(10) || p_type AS words FROM part"
_STEPS = "(SELECT count(*) FILTER (v - p = 1) > 0.95 * (SELECT count({c}) - 1 FROM {t}) FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM (SELECT DISTINCT {c} AS v FROM {t})))"


def _numeric(t: str, c: str) -> str:
    whole = f"(SELECT bool_and({c} = floor({c})) FROM {t})"
    seq = f"({whole} AND {_STEPS.format(c=c, t=t)})"
    named = str(any(w in c for w in P.ID_WORDS)).lower()
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CASE WHEN {seq} THEN 'SEQUENTIAL' WHEN (SELECT count(DISTINCT {c}) > 0.95 * count({c}) FROM {t}) THEN 'UNIQUE_NUMERIC' ELSE 'NON_UNIQUE_NUMERIC' END AS numeric_pattern, CASE WHEN {seq} THEN 'SURROGATE' WHEN {named} THEN 'NATURAL' END AS key_kind"


def _other(t: str, c: str) -> str:
    named = str(any(w in c for w in P.ID_WORDS)).lower()
    return f"SELECT '{t}', '{c}', NULL, CASE WHEN {named} THEN 'NATURAL' END"


def _profile(c: str, at: int, kind: str) -> str:
    number = kind in ("int", "float")
    stats = f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean" if number else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean"
    whole = f"CASE WHEN bool_and({c} = floor({c})) THEN 'int' ELSE 'float' END" if number else f"'{kind}'"
    seq = f"bool_and({c} = floor({c})) AND {_STEPS.format(c=c, t='orders')}" if number else "NULL"
    unique = f"count(DISTINCT {c}) * 100.0 / count({c})"
    return f"SELECT '{c}' AS \"column\", {at}::BIGINT AS ordinal, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, count({c}) - count(DISTINCT {c}) AS duplicate_count, round({unique}, 4) AS unique_percent, {whole} AS data_type, {stats}, {seq} AS is_sequential, {unique} >= 99.9 AND count(DISTINCT {c}) >= 10 AS primary_key_candidate FROM orders"


_ORDERS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")]

ORACLE_SQL = {
    "state_look_up": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "state_exists": "SELECT s AS status, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = s) AS found FROM (VALUES ('F'), ('X')) v(s)",
    "state_joins": "SELECT 'calculations' AS relation, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'validations', count(*), CAST(sum(o_custkey) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'passed_validations', count(*), CAST(sum(o_custkey) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' UNION ALL SELECT 'corrections', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM events JOIN customer ON user_id = c_custkey UNION ALL SELECT 'slices', count(*), CAST(sum(s_nationkey) AS BIGINT) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "state_grouped_slices": "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1",
    "state_current": f"WITH c AS ({_CHANGES}) SELECT user_id, arg_max(status, event_id) AS status, arg_max(stage, event_id) FILTER (stage IS NOT NULL) AS stage, min(event_id) FILTER (status = 'RUNNING') AS started_at, max(event_id) FILTER (status IN ('DONE', 'FAILED')) AS completed_at FROM c GROUP BY 1",
    "state_cascade": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 3) GROUP BY 1",
    "state_clean_up": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 DAY AND o_orderstatus IN ('F', 'O')) GROUP BY 1",
    "state_of_status": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1",
    "state_flagged": "SELECT n_nationkey, n_nationkey IN (1, 3, 5) AS deleted FROM nation",
    "state_recent": "SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 10",
    "state_report": "SELECT CASE WHEN (o_orderkey % 100) / 100.0 > 0.95 THEN 'Passed' WHEN o_orderstatus = 'O' THEN 'Passed' WHEN o_orderstatus = 'F' THEN 'Failed' ELSE 'Not validated' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "first_seen_lists": "SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1",
    "patterns_summary": f"SELECT tag, count(*) AS n, string_agg(DISTINCT difficulty, ',' ORDER BY difficulty) AS difficulties FROM (SELECT unnest(tags) AS tag, difficulty FROM ({_PATTERNS})) GROUP BY 1",
    "patterns_found": f"WITH p AS ({_PATTERNS}) SELECT 'id' AS \"by\", count(*) AS n FROM p WHERE id = '7' UNION ALL SELECT 'tag', count(*) FROM p WHERE list_contains(tags, (SELECT min(p_brand) FROM part)) UNION ALL SELECT 'difficulty', count(*) FROM p WHERE difficulty = 'hard' UNION ALL SELECT 'words', count(*) FROM p WHERE contains(lower(words), 'a')",
    "profile_numeric_pattern": " UNION ALL ".join([*[_numeric("orders", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")], *[_numeric("part", c) for c in ("p_partkey", "p_size", "p_retailprice")], *[_other("orders", c) for c in ("o_orderstatus", "o_orderdate", "o_orderpriority")], *[_other("part", c) for c in ("p_name", "p_brand", "p_type")]]),
    "sample_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", string_agg(v, ',' ORDER BY v) AS samples FROM (SELECT DISTINCT {c} AS v FROM customer WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)" for c in ("c_name", "c_mktsegment")),
    "column_preview": "WITH t AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderstatus FROM orders) " + " UNION ALL ".join(f"SELECT 'orders' AS \"table\", '{c}' AS \"column\", 'string' AS data_type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)) AS samples FROM t" for c in ("priority", "o_orderstatus")),
    "table_summary": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, (SELECT CAST(sum(n) AS BIGINT) FROM (UNPIVOT (SELECT CAST(count(*) - count(COLUMNS(*)) AS BIGINT) FROM {t}) ON COLUMNS(*) INTO NAME k VALUE n)) AS null_cells, (SELECT string_agg(c, ',' ORDER BY place) FROM {_COLS[t]}) AS columns" for t in STAR),
    "column_profile_all": " UNION ALL ".join(_profile(c, i, k) for i, (c, k) in enumerate(_ORDERS)),
    "json_rows": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id * 0.5 END::DOUBLE AS x, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type FROM events",
    "name_hints": f"SELECT \"table\", c AS \"column\", replace(lower(c), '_', ' ') AS words, CASE WHEN list_has_any(string_split(lower(c), '_'), ['customer', 'client']) THEN 'Customer' WHEN list_has_any(string_split(lower(c), '_'), ['product', 'item']) THEN 'Product' WHEN list_has_any(string_split(lower(c), '_'), ['order']) THEN 'Order' ELSE 'Unknown' END AS subject, regexp_matches(lower(c), 'id|key|code|number|_no|_num') AS looks_like_id, contains(lower(c), 'name') AS looks_like_name, regexp_matches(replace(lower(c), '_', ' '), 'phone|tel') AS looks_like_phone FROM ({_ALL})",
    "agg_sql_text": "SELECT o_orderstatus, CAST(round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS DOUBLE) AS truth_value FROM orders GROUP BY 1",
    "fidelity_context_nulls": "WITH t AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, o_totalprice FROM orders) SELECT DISTINCT status, priority, round(sum(o_totalprice) OVER (PARTITION BY status), 2) AS candidate_value FROM t",
    "state_merged": """WITH h AS (SELECT max(event_id) // 2 AS h FROM events), c AS (SELECT c_custkey AS id, -1 AS "at", 'new' AS status, c_acctbal AS value, false AS gone FROM customer
UNION ALL SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN value END, event_id % 11 = 5 FROM events),
v AS (SELECT * FROM c, (SELECT 1 AS n, -1 AS upto UNION ALL SELECT 2, h FROM h UNION ALL SELECT unnest([3, 4]), max(event_id) FROM events) WHERE "at" <= upto),
z AS (SELECT n, id, max("at") FILTER (gone) AS dead FROM v GROUP BY 1, 2),
r AS (SELECT n, id, max("at") AS "at", arg_max(status, "at") AS status, arg_max(value, "at") AS value FROM v JOIN z USING (n, id) WHERE dead IS NULL OR "at" > dead GROUP BY 1, 2)
SELECT CAST(id AS BIGINT) AS id, CAST("at" AS BIGINT) AS "at", status, value FROM r WHERE n = 4 UNION ALL SELECT -n, count(*), 'version', NULL FROM r GROUP BY n""",
    "state_cascade_tree": """WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), p AS (SELECT * FROM part WHERE p_size <= 40),
l AS (SELECT CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) THEN l_partkey END AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)))
SELECT 'customer' AS "table", count(*) AS n, count(c_custkey) AS named, CAST(sum(c_custkey) AS BIGINT) AS total FROM c UNION ALL SELECT 'orders', count(*), count(o_custkey), sum(o_custkey) FROM o UNION ALL SELECT 'part', count(*), count(p_partkey), sum(p_partkey) FROM p
UNION ALL SELECT 'events', count(*), count(user_id), sum(user_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'lineitem', count(*), count(k), sum(k) FROM l""",
    "fidelity_context": "SELECT DISTINCT o_orderstatus, o_orderpriority, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS candidate_value FROM orders",
    "join_calendar": "SELECT year(o_orderdate) AS Year, isodow(o_orderdate) >= 6 AS IsWeekend, count(*) AS n FROM orders GROUP BY 1, 2",
    "model_totals": "SELECT 8::BIGINT AS tables, " + " + ".join(f"(SELECT count(*) FROM {t})" for t in STAR) + " AS rows, CAST((SELECT count(*) > 100000 FROM lineitem) AS BIGINT) AS facts, 8 - CAST((SELECT count(*) > 100000 FROM lineitem) AS BIGINT) AS dimensions",
    "slice_keys": "SELECT o_orderpriority || '|' || coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'None') AS slice, count(*) AS n FROM orders GROUP BY 1",
    "number_formats": "SELECT n_nationkey, raw, CASE WHEN contains(raw, 'M') AND contains(raw, '0') THEN '#,##0,,\" M\"' WHEN contains(raw, '%') THEN '0.00%' WHEN contains(raw, '#,##0') THEN '#,##0' WHEN contains(raw, '0.00') THEN '#,##0.00' ELSE raw END AS format FROM (SELECT n_nationkey, ['#,##0', '0.0%', '0,,M', '0.00', '*x'][n_nationkey % 5 + 1] AS raw FROM nation)",
    "caption_formulas": "SELECT n_nationkey, formula, regexp_matches(formula, 'Calculation_[0-9]+') AS unresolved, 'orders.x,nation.y' AS fields FROM (SELECT n_nationkey, 'SUM([' || CASE n_regionkey WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Cost' ELSE 'Calculation_' || n_regionkey END || ']) / [x (orders)] + [y (nation)]' AS formula FROM nation)",
    "filter_kinds": "SELECT n_nationkey, ['BASIC', 'ADVANCED', 'RELATIVE_DATE', 'TOP_N', 'BASIC'][n_nationkey % 5 + 1] AS kind FROM nation",
    "rel_formats": "WITH n AS (SELECT count(DISTINCT c_custkey) AS k FROM customer WHERE c_custkey % 4 <> 0) SELECT a AS source_column, b AS target_column, m AS detection_method, t AS transformation, 75::BIGINT AS confidence_score, 100.0::DOUBLE AS overlap_percent, k AS exact_matches FROM n, (VALUES ('segment_code', 'segment_code_b', 'CASE_MISMATCH', 'LOWER() or UPPER()'), ('customer_ref', 'customer_ref_b', 'PREFIX_MISMATCH', 'STRIP_PREFIX(''CUST-'')')) v(a, b, m, t)",
    "rel_high_overlap": "WITH m AS (SELECT count(*) AS k FROM (SELECT DISTINCT s_nationkey AS v FROM supplier) JOIN nation ON v = n_nationkey), s AS (SELECT count(DISTINCT s_nationkey) AS n FROM supplier), o AS (SELECT k, round(k * 100.0 / least(n, (SELECT count(*) FROM nation)), 4) AS p FROM m, s) SELECT 'n_nationkey' AS source_column, 'home' AS target_column, 'HIGH' AS confidence_level, CAST(floor((p + 90) / 2) AS BIGINT) AS confidence_score, k AS exact_matches, p AS overlap_percent FROM o",
}
