"""Queries over overlaps, relationships and duplicate columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import matcher_ratio_udf, normalized_col, token_ratio_udf, variations
from ..operators import duplicates as D
from ..operators import overlap as O  # noqa: E741
from ..operators import relationships as R
from ..operators.kept import KeptColumns
from .common import STAR, star, table

#: Integer key columns of all star tables.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"]}


def overlap_pair(spark, d):
    v = lambda t, c: O.distinct_values(table(spark, d, t), F.col(c))
    return O.overlap(v("orders", "o_custkey"), v("customer", "c_custkey"))


def overlap_all_pairs(spark, d):
    return O.pair_overlaps(O.values_of(star(spark, d, [*KEYS]), KEYS))


def overlap_wide_keys(spark, d):
    """All pairs of key columns beyond 2**53: a bigint, a decimal that is one less for every third key, and a double of small keys beside its bigint."""
    big = F.lit(1 << 60)
    o = table(spark, d, "orders").select((F.col("o_orderkey") + big).alias("big"), F.col("o_custkey").cast("double").alias("small"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") + big - (F.col("l_orderkey") % 3 == 0).cast("long")).cast("decimal(38,0)").alias("huge"), F.col("l_suppkey").alias("plain"))
    return O.pair_overlaps(O.values_of({"a": o, "b": li}))


def orphans(spark, d):
    """Customers without a finished order that is urgent: keys that only one side has."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_custkey % 3 = 0")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def jaccard_content(spark, d):
    return D.jaccard(table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("Z").alias("other")), "o_orderstatus", "other")


def fuzzy_overlap(spark, d):
    names = O.distinct_values(table(spark, d, "part"), F.col("p_name"))
    return R.fuzzy_overlap(names, names.select(F.when(F.pmod(F.crc32("value"), F.lit(3)) == 0, F.concat("value", F.lit("s"))).otherwise(F.col("value")).alias("value")).distinct())


def fuzzy_all_pairs(spark, d):
    """Values in common and values that are nearly alike, for two columns of texts against two that were changed by the length of their texts."""
    kind = F.concat_ws(" ", "p_type", "p_brand")
    a = table(spark, d, "part").select(F.col("p_name").alias("part_name"), kind.alias("part_kind"))
    by = F.length("part_name") % 3
    b = a.select(
        F.when(by == 0, F.concat("part_name", F.lit("s"))).when(by == 1, F.replace("part_name", F.lit("e"), F.lit(""))).otherwise(F.col("part_name")).alias("part_names"),
        F.when(F.length("part_kind") % 2 == 0, F.replace("part_kind", F.lit("#"), F.lit(""))).otherwise(F.col("part_kind")).alias("part_kinds"),
    )
    values, ends = O.values_of({"a": a, "b": b}), ["table1", "column1", "table2", "column2"]
    pairs = spark.createDataFrame([("a", x, "b", y) for x in a.columns for y in b.columns], ", ".join(f"{c} string" for c in ends))
    exact = O.pair_overlaps(values).select(*ends, "exact_matches")
    met = pairs.join(O.fuzzy_pairs(values, pairs), ends, "left").join(exact, ends, "left")  # a row a pair of columns
    return met.select("column1", "column2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exact_matches", "fuzzy_matches")])


def rel_rerun(spark, d):
    """Relationships after a person dropped one column and renamed another; the values are those of the first run."""
    kept = KeptColumns(_two(spark, d))
    R.discover(kept)
    changed = kept.dropped("b", "cust_id").renamed("b", {"customer_id": "cust_id"})
    return R.discover(changed).select("source_column", "target_column", "relationship_type", "confidence_level", "confidence_score", "detection_method", "cardinality", "overlap_percent", "exact_matches")


def _two(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("agent_ref"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("cust_id"), F.col("o_orderkey").alias("order_no"))
    return {"a": a, "b": b}


def rel_rules(spark, d):
    return R.discover(_two(spark, d)).select("source_column", "target_column", "relationship_type", "confidence_level", "confidence_score", "detection_method", "cardinality")


def rel_warnings(spark, d):
    """Nulls on one side and orphans on the other."""
    a = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("cust_id"), "c_name")
    b = table(spark, d, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("cust_id"), "o_orderkey")
    return R.discover({"a": a, "b": b}).select("source_column", "target_column", F.explode("warnings").alias("warning"))


def relationship_report(spark, d):
    return R.discover(star(spark, d))


def relationship_levels(spark, d):
    return R.report(R.discover(_two(spark, d)))


def rel_format(spark, d):
    c = table(spark, d, "customer")
    base = c.select(F.concat(F.lit("Seg"), F.col("c_custkey")).alias("v"), F.concat(F.lit("CUST-"), F.col("c_custkey")).alias("p"), F.concat(F.lit("zone/"), F.col("c_custkey")).alias("s"))
    other = c.select(F.upper(F.concat(F.lit("Seg"), F.col("c_custkey"))).alias("v"), F.col("c_custkey").cast("string").alias("p"))
    out = None
    for name, x, y in (("case", "v", "v"), ("prefix", "p", "p"), ("partial", "s", "p"), ("none", "p", "v")):
        made = R.format_mismatch(base, x, other, y).select(F.lit(name).alias("pair"), "*")
        out = made if out is None else out.unionByName(made)
    return out


def entity_typing(spark, d):
    """Entities of the star tables and of tables named after nations, the rest by their columns."""
    of = [(t, table(spark, d, t).columns) for t in STAR] + [("misc", ["row_id", "start_date", "amount"]), ("other", ["row_id"]), ("none", ["x"])]
    named = spark.createDataFrame(of, "table string, columns array<string>").unionByName(table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.element_at(F.array(*map(F.lit, ["_payment", "_claim", "_branch"])), (F.col("n_nationkey") % 3 + 1).cast("int"))).alias("table"), F.array().cast("array<string>").alias("columns")))
    return named.select("table", R.entity(F.col("table"), F.col("columns")).alias("entity"))


def name_functions(spark, d):
    pairs = [("Cust_ID", "customer-id"), ("o_custkey", "c_custkey"), ("Agent Code", "agt_code")]
    df = spark.createDataFrame(pairs, "a string, b string")
    ratios = df.select("a", normalized_col(F.col("a")).alias("normalized"), F.round(token_ratio_udf("a", "b"), 6).alias("token_ratio"), F.round(matcher_ratio_udf("a", "b"), 6).alias("matcher_ratio"))
    known = F.create_map(*[x for a, _ in pairs for x in (F.lit(a), F.lit(",".join(variations(a))))])
    return ratios.withColumn("variations", F.element_at(known, F.col("a")))


def _copies(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("C_CustKey_"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")).alias("c_custkey_2"), "c_name", F.col("c_acctbal"), (F.col("c_acctbal") * 1.0005).alias("near"), (F.col("c_acctbal") * 1.01).alias("far"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("x").alias("half"))


def dup_columns_measures(spark, d):
    return D.pair_measures(_copies(spark, d), [("c_custkey", "C_CustKey_"), ("c_custkey", "c_custkey_2"), ("c_acctbal", "near"), ("c_acctbal", "far"), ("c_name", "half")])


def dup_columns_groups(spark, d):
    made = D.duplicate_columns(_copies(spark, d).drop("near", "far", "half"))
    return spark.createDataFrame([(g["rule"], ",".join(g["columns"]), all(g["identical"]), D.recommendation(g)) for g in made], "rule string, columns string, identical boolean, recommendation string")


def _pairs_sql() -> str:
    cols = [(t, c) for t, cs in KEYS.items() for c in cs]
    union = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in cols)
    return f"""WITH v AS ({union}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL)
SELECT a.t AS table1, a.c AS column1, b.t AS table2, b.c AS column2, count(*) AS exact_matches, any_value(x.n) AS cardinality1, any_value(y.n) AS cardinality2,
       round(count(*) * 100.0 / least(any_value(x.n), any_value(y.n)), 4) AS overlap_percent, any_value(x.n) - count(*) AS orphans1, any_value(y.n) - count(*) AS orphans2
FROM v a JOIN v b ON a.v = b.v AND a.t < b.t JOIN n x ON x.t = a.t AND x.c = a.c JOIN n y ON y.t = b.t AND y.c = b.c GROUP BY a.t, a.c, b.t, b.c"""


def _entity_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in R.ENTITIES)
    cols = " UNION ALL ".join(f"SELECT '{t}' AS t, list(column_name) AS cs FROM (DESCRIBE {t})" for t in STAR)
    some = lambda p: f"len(list_filter(cs, lambda x: regexp_matches(lower(x), '{p}'))) > 0"
    return f"""SELECT t AS "table", CASE {cases} WHEN {some('_id|id$')} AND {some('date|time')} AND {some('amount|price|value')} THEN 'Transaction - Unknown Type' WHEN {some('_id|id$')} AND NOT {some('date|time')} THEN 'Master Data - Unknown Type' ELSE 'Unknown Entity Type' END AS entity
FROM ({cols} UNION ALL SELECT * FROM (VALUES ('misc', ['row_id', 'start_date', 'amount']), ('other', ['row_id']), ('none', ['x'])) UNION ALL SELECT lower(n_name) || ['_payment', '_claim', '_branch'][n_nationkey % 3 + 1], [] FROM nation)"""


QUERIES = {f.__name__: f for f in (overlap_pair, overlap_all_pairs, overlap_wide_keys, orphans, jaccard_content, fuzzy_overlap, fuzzy_all_pairs, rel_rerun, rel_rules, rel_warnings, relationship_report, relationship_levels, rel_format, entity_typing, name_functions, dup_columns_measures, dup_columns_groups)}

_COPIES = "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS c2, c_acctbal, c_acctbal * 1.0005 AS near, c_acctbal * 1.01 AS far FROM customer"
_TOLERANT = "round(avg(CASE WHEN abs(c_acctbal - {x}) < 0.001 * greatest(abs(c_acctbal), abs({x}), 1.0) THEN 1.0 ELSE 0.0 END), 6)"


def _fuzzy_sql() -> str:
    """Likeness by the longest common subsequence of texts whose words are sorted, over all pairs of values that an edit distance leaves."""
    sides = {"part_name": "p_name", "part_kind": "concat_ws(' ', p_type, p_brand)"}
    changed = {"part_names": "CASE length(v) % 3 WHEN 0 THEN v || 's' WHEN 1 THEN replace(v, 'e', '') ELSE v END", "part_kinds": "CASE length(v) % 2 WHEN 0 THEN replace(v, '#', '') ELSE v END"}
    left = " UNION ".join(f"SELECT '{c}' AS c, {x} AS v FROM part WHERE {x} IS NOT NULL" for c, x in sides.items())
    right = " UNION ".join(f"SELECT '{c}' AS c, {x} AS v FROM l WHERE c = '{s}'" for (c, x), s in zip(changed.items(), sides))
    words = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda w: w <> '')), ' ')"
    matches = "list_transform(string_split(s, ''), lambda x: list_transform(string_split(t, ''), lambda y: (x = y)::INT))"
    step = "list_transform(range(1, length(t) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + m[k]))))"
    lcs = f"list_last(list_reduce(list_concat([list_transform(string_split(t, ''), lambda y: 0)], {matches}), lambda r, m: {step}))"
    return f"""WITH l AS ({left}), r AS ({right}), p AS (SELECT DISTINCT x.c AS c, y.c AS d FROM l x, r y),
ml AS (SELECT p.c, p.d, l.v FROM p JOIN l ON l.c = p.c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = p.d AND r.v = l.v)), mr AS (SELECT p.c, p.d, r.v FROM p JOIN r ON r.c = p.d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c = p.c AND l.v = r.v)),
near AS MATERIALIZED (SELECT * FROM (SELECT ml.c, ml.d, ml.v, {words.format('ml.v')} AS s, {words.format('mr.v')} AS t FROM ml JOIN mr USING (c, d)) WHERE levenshtein(s, t) <= 0.15 * (length(s) + length(t))),
f AS (SELECT c, d, count(DISTINCT v) AS n FROM near WHERE 2.0::DOUBLE * {lcs} / (length(s) + length(t)) > 0.85::DOUBLE GROUP BY ALL),
e AS (SELECT p.c, p.d, count(*) AS n FROM p JOIN l ON l.c = p.c JOIN r ON r.c = p.d AND r.v = l.v GROUP BY ALL)
SELECT p.c AS column1, p.d AS column2, coalesce(e.n, 0) AS exact_matches, coalesce(f.n, 0) AS fuzzy_matches FROM p LEFT JOIN e ON e.c = p.c AND e.d = p.d LEFT JOIN f ON f.c = p.c AND f.d = p.d"""


ORACLE_SQL = {
    "fuzzy_all_pairs": _fuzzy_sql(),
    "rel_rerun": """WITH n AS (SELECT count(DISTINCT c_custkey) = count(*) AS u, count(*) AS n FROM customer), o AS (SELECT count(*) AS k, (SELECT count(DISTINCT o_custkey) FROM orders) AS m FROM (SELECT DISTINCT o_custkey AS v FROM orders) JOIN customer ON v = c_custkey)
SELECT 'cust_id' AS source_column, 'cust_id' AS target_column, CASE WHEN u THEN 'PRIMARY_KEY -> FOREIGN_KEY' ELSE 'POTENTIAL_JOIN' END AS relationship_type, 'HIGH' AS confidence_level, 95::BIGINT AS confidence_score, 'EXACT_NAME_AND_TYPE_MATCH' AS detection_method, CASE WHEN u THEN '1:N' ELSE 'UNKNOWN' END AS cardinality,
       round(k * 100.0 / least(n, m), 4) AS overlap_percent, k AS exact_matches FROM n, o WHERE k * 100.0 / least(n, m) >= 80""",
    "overlap_pair": "WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL), b AS (SELECT DISTINCT c_custkey AS v FROM customer), j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.v = b.v) SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS exact_matches, count(*) FILTER (y IS NULL) AS orphans1, count(*) FILTER (x IS NULL) AS orphans2, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) * 100.0 / least(count(x), count(y)), 4) AS overlap_percent, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) * 100.0 / count(*), 4) AS jaccard_percent FROM j",
    "overlap_all_pairs": _pairs_sql(),
    "overlap_wide_keys": """WITH v AS (SELECT DISTINCT 'a' AS t, 'big' AS c, CAST(o_orderkey + 1152921504606846976 AS HUGEINT) AS v FROM orders UNION SELECT 'a', 'small', o_custkey FROM orders UNION SELECT 'b', 'huge', l_orderkey + 1152921504606846976 - (l_orderkey % 3 = 0)::INT FROM lineitem UNION SELECT 'b', 'plain', l_suppkey FROM lineitem),
n AS (SELECT t, c, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT 'a' AS table1, a.c AS column1, 'b' AS table2, b.c AS column2, count(*) AS exact_matches, any_value(x.n) AS cardinality1, any_value(y.n) AS cardinality2, round(count(*) * 100.0 / least(any_value(x.n), any_value(y.n)), 4) AS overlap_percent, any_value(x.n) - count(*) AS orphans1, any_value(y.n) - count(*) AS orphans2
FROM v a JOIN v b ON a.v = b.v AND a.t < b.t JOIN n x ON x.t = a.t AND x.c = a.c JOIN n y ON y.t = b.t AND y.c = b.c GROUP BY a.c, b.c""",
    "orphans": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey % 3 = 0)",
    "jaccard_content": "WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders), b AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'Z' END AS v FROM orders) SELECT round((SELECT count(*) FROM a JOIN b USING (v)) * 1.0 / (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)), 6) AS jaccard",
    "rel_format": "SELECT * FROM (VALUES ('case', 'CASE_MISMATCH', 'LOWER() or UPPER()', 100.0::DOUBLE), ('prefix', 'PREFIX_MISMATCH', 'STRIP_PREFIX(''CUST-'')', 100.0), ('partial', 'PARTIAL_MATCH', 'SUBSTRING or EXTRACT', 100.0)) v(pair, kind, transformation, overlap_percent)",
    "entity_typing": _entity_sql(),
    "dup_columns_measures": f"WITH t AS ({_COPIES}) SELECT 'c_custkey' AS column1, 'C_CustKey_' AS column2, true AS identical, 1.0::DOUBLE AS similarity UNION ALL SELECT 'c_custkey', 'c_custkey_2', count(*) FILTER (c_custkey IS DISTINCT FROM c2) = 0, 1.0 FROM t UNION ALL SELECT 'c_acctbal', 'near', count(*) FILTER (c_acctbal IS DISTINCT FROM near) = 0, {_TOLERANT.format(x='near')} FROM t UNION ALL SELECT 'c_acctbal', 'far', count(*) FILTER (c_acctbal IS DISTINCT FROM far) = 0, {_TOLERANT.format(x='far')} FROM t UNION ALL SELECT 'c_name', 'half', false, round((SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) * 1.0 / (SELECT count(*) + 1 FROM customer), 6)",
    "dup_columns_groups": "SELECT 'exact_name' AS rule, 'c_custkey,C_CustKey_' AS columns, true AS identical, 'keep c_custkey, delete C_CustKey_: the values are the same' AS recommendation",
    "rel_rules": """WITH n AS (SELECT count(DISTINCT c_custkey) = count(*) AS u FROM customer), o AS (SELECT count(*) * 100.0 / least((SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)) AS p FROM (SELECT DISTINCT o_custkey AS v FROM orders) JOIN customer ON v = c_custkey)
SELECT 'cust_id' AS source_column, t AS target_column, CASE WHEN u THEN 'PRIMARY_KEY -> FOREIGN_KEY' ELSE 'POTENTIAL_JOIN' END AS relationship_type, 'HIGH' AS confidence_level, s AS confidence_score, m AS detection_method, CASE WHEN u THEN '1:N' ELSE 'UNKNOWN' END AS cardinality
FROM n, o, (VALUES ('cust_id', 95::BIGINT, 'EXACT_NAME_AND_TYPE_MATCH'), ('customer_id', 90, 'NAME_VARIATION_MATCH')) v(t, s, m) WHERE p >= 80""",
    "rel_warnings": """WITH a AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey % 7 <> 0)
SELECT 'cust_id' AS source_column, 'cust_id' AS target_column, 'nulls in a.cust_id' AS warning FROM a HAVING count(*) FILTER (v IS NULL) * 100.0 / count(*) > 5 UNION ALL SELECT 'cust_id', 'cust_id', 'orphans in a.cust_id' FROM a WHERE v IS NOT NULL HAVING count(*) FILTER (v NOT IN (SELECT v FROM b)) * 100.0 / count(*) > 5""",
}
