"""Relationship discovery between tables: rules over pairs of columns, first match wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import token_ratio, variations
from ..functions.typed import as_text
from .kept import PAIR, KeptColumns
from .overlap import fuzzy_matches, overlap, pair_overlaps
from .profile import data_type_of, distinct_values, profiles_from
from .sketches import can_reach, estimated

HIGH, MEDIUM, LOW = 80, 60, 40
HALF, SURE = 50, 60
MOST_NULLS = MOST_ORPHANS = 5.0
FORMAT_NAMES, SEMANTIC_NAMES = 0.7, 0.6
RELATIONSHIP = "relationship_id string, source_table string, source_column string, target_table string, target_column string, relationship_type string, confidence_level string, confidence_score long, detection_method string, overlap_percent double, exact_matches long, orphans_in_source long, orphans_in_target long, cardinality string, warnings array<string>, requires_validation boolean, transformation string"
# Prefixes of codes that one side of a pair may lack.
PREFIXES = ["CUST-", "PROD-", "ORD-", "INV-"]
# Business entities by parts of table names, in this order.
ENTITIES = [
    ("Master Data - People/Entities", "customer|client|user|member|patient|employee|contact"), ("Master Data - Products/Items", "product|item|sku|inventory|catalog|part"), ("Master Data - Locations", "location|store|warehouse|facility|branch"),
    ("Master Data - Partners", "supplier|vendor|partner|agent|broker"), ("Transaction - Sales/Orders", "order|sale|purchase|transaction|booking"), ("Transaction - Financial", "payment|invoice|billing|revenue|premium"),
    ("Transaction - Service/Claims", "claim|incident|case|ticket|issue"), ("Transaction - Operations", "shipment|delivery|fulfillment|logistics"), ("Event - Activity/Engagement", "visit|session|activity|interaction|event|log"),
    ("Relationship - Junction Table", "assignment|mapping|link|association"), ("Reference - Lookup/Codes", "status|type|category|code|lookup|reference"),
]


def profiles_of(tables: dict[str, DataFrame], statistics: bool = True) -> DataFrame:
    """Column profiles of all tables, their values shuffled together once a type."""
    return profiles_from(tables, distinct_values(tables), statistics)


def cardinality(unique1: Column, unique2: Column) -> tuple[Column, Column]:
    """(relationship type, cardinality) by which sides are unique."""
    kind = F.when(unique1 & unique2, "ONE_TO_ONE").when(unique1, "PRIMARY_KEY -> FOREIGN_KEY").when(unique2, "FOREIGN_KEY -> PRIMARY_KEY").otherwise("POTENTIAL_JOIN")
    ratio = F.when(unique1 & unique2, "1:1").when(unique1, "1:N").when(unique2, "N:1").otherwise("UNKNOWN")
    return kind, ratio


def name_pairs(columns: dict[str, list[str]]) -> list[tuple]:
    """(table1, column1, table2, column2, equal, variant, similarity) for columns of different tables. Metadata: a pair of names each."""
    return [(s, c, t, d, c == d, bool({*variations(c)} & {*variations(d)}), token_ratio(c, d)) for s, t in combinations(sorted(columns), 2) for c in columns[s] for d in columns[t]]


def candidates(profiles: DataFrame, overlaps: DataFrame, names: DataFrame, validator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs that a rule on names and exact overlap accepts, with type, confidence, statistics and warnings.

    Rules in order: the same name and type with one unique side; a variation of the name; a similar name (to be validated). With a
    validator, what needs validation is what it returns.
    """
    side = lambda k: profiles.select(*[F.col(c).alias(f"{a}{k}") for c, a in (("table", "table"), ("column", "column"), ("data_type", "type"), ("is_unique", "unique"), ("null_percent", "nulls"))])
    p = overlaps.join(F.broadcast(names), ["table1", "column1", "table2", "column2"]).join(F.broadcast(side(1)), ["table1", "column1"]).join(F.broadcast(side(2)), ["table2", "column2"])
    p = p.where((F.col("type1") == F.col("type2")) & (F.col("overlap_percent") >= LOW))
    share, (kind, ratio) = F.col("overlap_percent"), cardinality(F.col("unique1"), F.col("unique2"))
    exact = F.col("equal") & (share >= HIGH) & (F.col("unique1") | F.col("unique2"))
    variant, semantic = F.col("variant") & (share >= HIGH), F.col("similarity") >= SEMANTIC_NAMES
    p = p.withColumn("rule", F.when(exact, "EXACT_NAME_AND_TYPE_MATCH").when(variant, "NAME_VARIATION_MATCH").when(semantic, "SEMANTIC_SIMILARITY")).where("rule is not null")
    by_rule = lambda e, v, s: F.when(F.col("rule").startswith("EXACT"), e).when(F.col("rule").startswith("NAME"), v).otherwise(s)
    orphans = F.round(F.col("orphans1") * 100.0 / F.col("cardinality1"), 4)
    warnings = F.array_compact(F.array(
        F.when(F.col("nulls1") > MOST_NULLS, F.concat_ws(" ", F.lit("nulls in"), F.concat_ws(".", "table1", "column1"))), F.when(F.col("nulls2") > MOST_NULLS, F.concat_ws(" ", F.lit("nulls in"), F.concat_ws(".", "table2", "column2"))),
        F.when(orphans > MOST_ORPHANS, F.concat_ws(" ", F.lit("orphans in"), F.concat_ws(".", "table1", "column1"))),
    ))
    out = p.select(
        F.col("table1").alias("source_table"), F.col("column1").alias("source_column"), F.col("table2").alias("target_table"), F.col("column2").alias("target_column"),
        by_rule(kind, kind, F.lit("SEMANTIC_MATCH")).alias("relationship_type"), by_rule(F.lit("HIGH"), F.lit("HIGH"), F.when(share > MEDIUM, "MEDIUM").otherwise("LOW")).alias("confidence_level"),
        by_rule(F.lit(95), F.lit(90), F.floor(50 + share / 2).cast("int")).cast("long").alias("confidence_score"), F.col("rule").alias("detection_method"), "overlap_percent", "exact_matches",
        F.col("orphans1").alias("orphans_in_source"), F.col("orphans2").alias("orphans_in_target"), by_rule(ratio, ratio, F.lit("UNKNOWN")).alias("cardinality"), warnings.alias("warnings"), (F.col("rule") == "SEMANTIC_SIMILARITY").alias("requires_validation"),
    )
    return out if validator is None else out.where(~F.col("requires_validation")).unionByName(validator(out.where("requires_validation")))


def _unprefixed(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 1 << 30)).otherwise(value)


def _changes(value: Column) -> dict[str, tuple[str, Column]]:
    """Changes of format by a key: (transformation, the value after it)."""
    stripped = {f"PREFIX_MISMATCH{i}": (f"STRIP_PREFIX('{p}')", _unprefixed(value, p)) for i, p in enumerate(PREFIXES)}
    last = F.substring_index(F.translate(value, "-_/", "   "), " ", -1)
    return {"CASE_MISMATCH": ("LOWER() or UPPER()", F.lower(value)), **stripped, "PARTIAL_MATCH": ("SUBSTRING or EXTRACT", last)}


def _forms(value: Column, t: T.DataType) -> list[Column]:
    """The changed values that a sketch is kept of. Texts of whole numbers, dates and times have neither letters nor prefixes."""
    made = [F.when(v != "", v) for _, v in _changes(value).values()]
    if isinstance(t, T.IntegralType):
        return [*[value] * (len(made) - 1), F.when(value.startswith("-"), made[-1]).otherwise(value)]
    return [*[value] * (len(made) - 1), made[-1]] if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else made


def format_pairs(values: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (of near) of columns that meet after a change of format: pair_overlaps' columns, kind and transformation.

    The overlap after the change reaches MEDIUM; the first such change counts. The changed values of all columns
    go through one more table of values and one count of pairs.
    """
    sides = near.select(F.explode(F.array(F.struct(F.col("table1").alias("table"), F.col("column1").alias("column")), F.struct(F.col("table2").alias("table"), F.col("column2").alias("column")))).alias("s")).select("s.*").distinct()
    changes = _changes(F.col("value"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("value")) for i, (_, v) in enumerate(changes.values())])
    changed = values.join(F.broadcast(sides), ["table", "column"]).select("table", "column", F.inline(each)).where("value <> ''").groupBy("table", "column", "i", "value").agg(F.lit(1).alias("n"))
    apart = changed.select("table", F.concat_ws("\x01", "column", "i").alias("column"), F.concat_ws("\x01", "i", "value").alias("value"), "n")
    cut = lambda c, k: F.element_at(F.split(c, "\x01"), k)
    met = pair_overlaps(apart).withColumn("i", cut("column1", 2).cast("int")).withColumn("column1", cut("column1", 1)).withColumn("column2", cut("column2", 1)).where(F.col("overlap_percent") >= MEDIUM)
    on = ["table1", "column1", "table2", "column2"]
    first = met.join(F.broadcast(near.select(*on)), on).groupBy(*on).agg(F.min_by(F.struct(*[c for c in met.columns if c not in on]), "i").alias("f")).select(*on, "f.*")
    kinds = F.array(*[F.lit(k.rstrip("0123456789")) for k in changes])
    texts = F.array(*[F.lit(t) for t, _ in changes.values()])
    return first.withColumns({"kind": F.element_at(kinds, F.col("i") + 1), "transformation": F.element_at(texts, F.col("i") + 1)}).drop("i")


def _named(pairs: list[tuple]) -> DataFrame:
    return SparkSession.getActiveSession().createDataFrame(pairs, "table1 string, column1 string, table2 string, column2 string, equal boolean, variant boolean, similarity double")


@dataclass
class Survivors:
    """What a first scan leaves: pairs of columns whose values must be counted, pairs whose formats must be changed, pairs of similarly named texts, and what is known of the columns."""

    counted: list[tuple]
    changed: list[tuple]
    alike: list[tuple]
    facts: dict[tuple[str, str], dict]


def survivors(kept: KeptColumns, pairs: list[tuple], least: float = LOW) -> Survivors:
    """The pairs of name_pairs that values must decide, by one scan of their columns and without a shuffle of values.

    A pair of one type goes on if the ends of both columns meet and their sketches don't rule out an overlap of `least` percent. A pair
    of similar names goes on to changes of format if some change doesn't rule out MEDIUM; whole numbers without a minus sign
    are the same after every change. What is dropped can't meet a rule.
    """
    ends = lambda of: {(p[k], p[k + 1]) for p in of for k in (0, 2)}
    if not pairs:
        return Survivors([], [], [], {})
    made = kept.facts(ends(pairs), _forms, ends(p for p in pairs if p[6] >= FORMAT_NAMES))
    facts = {(r["table"], r["column"]): r.asDict() for r in made.drop("sketch", "forms").collect()}
    for f in facts.values():
        f["data_type"] = data_type_of(f["kind"], f["non_null"], f["whole"], f["numbers"], f["dates"])
        f["nulls"] = round((f["rows"] - f["non_null"]) * 100.0 / f["rows"], 4) if f["rows"] else 0.0
    estimates: dict[tuple, dict[int, tuple]] = {}
    for r in estimated(made, _named(pairs).select("table1", "column1", "table2", "column2")).collect():  # a row a pair of columns and form
        estimates.setdefault(tuple(r)[:4], {})[r["form"]] = (r["n1"], r["n2"], r["shared"])
    counted, changed, alike = [], [], []
    for p in pairs:
        a, b = facts.get(p[:2]), facts.get(p[2:4])
        if not (a and b and a["non_null"] and b["non_null"]):
            continue
        meet = a["low"] <= b["high"] and b["low"] <= a["high"]
        by_form = estimates[p[:4]]
        if a["data_type"] == b["data_type"] and meet and can_reach(least, *by_form[0]):
            counted.append(p)
        plain = all(x["kind"] == "NUMERIC" and x["data_type"] == "int" and not x["negative"] for x in (a, b))
        if p[6] >= FORMAT_NAMES and not plain and any(can_reach(MEDIUM, *e) for i, e in by_form.items() if i):
            changed.append(p)
        if p[6] >= FORMAT_NAMES and a["data_type"] == b["data_type"] == "string":
            alike.append(p)
    return Survivors(counted, changed, alike, facts)


def discover(
    tables: dict[str, DataFrame] | KeptColumns, validator: Callable[[DataFrame], DataFrame] | None = None, overlap_validator: Callable[[DataFrame], DataFrame] | None = None, fuzzy: bool = False
) -> DataFrame:
    """Relationships of all tables, best first, with ids in that order.

    Rules in order: equal names, variations, changes of format, values that are nearly alike, high overlap of unlike names, similar names.
    The third and fourth are for similar names; the fourth is asked for by fuzzy, takes columns of texts, and counts the values in common
    and those that an unmatched value of the other column is like. The fifth needs
    overlap_validator: it gets pairs of one type with at least half of the values in common and returns those it confirms with
    confidence (0 to 100). One scan with sketches drops the pairs of columns that can't meet a rule; only the distinct values of the other
    columns are shuffled and counted, exactly. Given as KeptColumns, what was computed before a person's changes is not computed again.
    """
    kept = tables if isinstance(tables, KeptColumns) else KeptColumns(tables)
    spark = next(iter(kept.tables.values())).sparkSession
    pairs = name_pairs(kept.columns)
    if overlap_validator is None:
        pairs = [p for p in pairs if p[4] or p[5] or p[6] >= SEMANTIC_NAMES]
    left = survivors(kept, pairs)
    counted = [*left.counted, *left.changed, *(left.alike if fuzzy else [])]
    if not counted:
        return spark.createDataFrame([], RELATIONSHIP)
    names, sizes = _named(pairs), kept.sizes({p[i : i + 2] for p in counted for i in (0, 2)})
    rows = [(t, c, f["data_type"], round(sizes[t, c] * 100.0 / f["non_null"], 4) >= 99.9, f["nulls"]) for (t, c), f in left.facts.items() if (t, c) in sizes]
    profiles = spark.createDataFrame(rows, "table string, column string, data_type string, is_unique boolean, null_percent double")
    overlaps = kept.overlaps(counted)
    # Of what is kept, formats of all similar names; which of them count follows from the overlaps.
    changed = kept.formats(left.changed, lambda values, wanted: format_pairs(values, wanted)) if left.changed else None
    on = [F.col("source_table") == F.col("table1"), F.col("source_column") == F.col("column1"), F.col("target_table") == F.col("table2"), F.col("target_column") == F.col("column2")]
    named = candidates(profiles, overlaps, names, None).withColumn("transformation", F.lit(None).cast("string"))
    sure = named.where(~F.col("requires_validation"))
    ends, found = ["source_table", "source_column", "target_table", "target_column"], sure
    other = lambda df, method, score, how: df.select(
        F.col("table1").alias("source_table"), F.col("column1").alias("source_column"), F.col("table2").alias("target_table"), F.col("column2").alias("target_column"), F.lit("FORMAT_MISMATCH").alias("relationship_type"), F.lit("MEDIUM").alias("confidence_level"),
        F.lit(score).cast("long").alias("confidence_score"), method.alias("detection_method"), "overlap_percent", "exact_matches", F.col("orphans1").alias("orphans_in_source"), F.col("orphans2").alias("orphans_in_target"), F.lit("UNKNOWN").alias("cardinality"),
        F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("requires_validation"), how.alias("transformation"),
    )
    met = overlaps.where(F.col("overlap_percent") >= MEDIUM)
    if changed is not None:
        changed = changed.join(F.broadcast(met), [*PAIR], "left_anti").join(F.broadcast(sure), on, "left_anti")
        found = found.unionByName(other(changed, F.col("kind"), 75, F.col("transformation")))
    if fuzzy and left.alike:
        taken = {tuple(r) for r in found.select(*ends).collect()} | {tuple(r) for r in met.select(*PAIR).collect()}  # a row a relationship
        if alike := [p for p in left.alike if p[:4] not in taken]:
            found = found.unionByName(other(nearly_alike(kept.fuzzy(alike), overlaps, sizes), F.lit("FUZZY_VALUES"), 75, F.lit("FUZZY JOIN")))
    if overlap_validator is not None:
        found = found.unionByName(_high_overlaps(profiles, overlaps, overlap_validator).join(F.broadcast(found.select(*ends)), ends, "left_anti"))
    similar = named.where("requires_validation").join(F.broadcast(found.select(*ends)), ends, "left_anti")
    found = found.unionByName(similar if validator is None else validator(similar))
    w = Window.orderBy(F.desc("confidence_score"), *ends)  # a row a relationship: metadata
    return found.select(F.format_string("REL_%03d", F.row_number().over(w)).alias("relationship_id"), "*")


def nearly_alike(fuzzy: DataFrame, overlaps: DataFrame, sizes: dict[tuple, int]) -> DataFrame:
    """pair_overlaps' columns of pairs whose values in common and alike reach MEDIUM percent of the smaller column's. exact_matches are those in common, orphans of the first column those of neither kind."""
    spark = fuzzy.sparkSession
    side = lambda k: spark.createDataFrame([(t, c, n) for (t, c), n in sizes.items()], f"table{k} string, column{k} string, n{k} long")
    p = fuzzy.join(F.broadcast(side(1)), ["table1", "column1"]).join(F.broadcast(side(2)), ["table2", "column2"]).join(F.broadcast(overlaps.select(*PAIR, "exact_matches")), [*PAIR], "left")
    p = p.withColumn("exact_matches", F.coalesce("exact_matches", F.lit(0)))
    share = F.round((F.col("exact_matches") + F.col("fuzzy_matches")) * 100.0 / F.least("n1", "n2"), 4)
    return p.select(*PAIR, "exact_matches", share.alias("overlap_percent"), (F.col("n1") - F.col("exact_matches") - F.col("fuzzy_matches")).alias("orphans1"), (F.col("n2") - F.col("exact_matches")).alias("orphans2")).where(F.col("overlap_percent") >= MEDIUM)


def _high_overlaps(profiles: DataFrame, overlaps: DataFrame, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of one type that share at least half of their values, as far as confirm returns them with a confidence of 60 or more."""
    side = lambda k: profiles.select(F.col("table").alias(f"table{k}"), F.col("column").alias(f"column{k}"), F.col("data_type").alias(f"type{k}"))
    p = overlaps.where(F.col("overlap_percent") >= HALF).join(F.broadcast(side(1)), ["table1", "column1"]).join(F.broadcast(side(2)), ["table2", "column2"]).where("type1 = type2")
    score = F.floor((F.col("overlap_percent") + F.col("confidence")) / 2).cast("long")
    return confirm(p).where(F.col("confidence") >= SURE).select(
        F.col("table1").alias("source_table"), F.col("column1").alias("source_column"), F.col("table2").alias("target_table"), F.col("column2").alias("target_column"), F.lit("VALIDATED_OVERLAP").alias("relationship_type"),
        F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW").alias("confidence_level"), score.alias("confidence_score"), F.lit("HIGH_OVERLAP_VALIDATION").alias("detection_method"), "overlap_percent", "exact_matches",
        F.col("orphans1").alias("orphans_in_source"), F.col("orphans2").alias("orphans_in_target"), F.lit("UNKNOWN").alias("cardinality"), F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("requires_validation"),
        F.lit(None).cast("string").alias("transformation"),
    )


def format_mismatch(a: DataFrame, column1: str, b: DataFrame, column2: str) -> DataFrame:
    """(kind, transformation, overlap_percent) of the change of format that gives two text columns the largest overlap of at least MEDIUM; none if the raw values have it already.

    Changes: lower case, a known prefix taken off, values of one side standing in those of the other after a mark.
    """
    value = lambda df, c, f: df.select(f(as_text(df, c)).alias("value")).where("value is not null").distinct()
    same = lambda x: x
    stripped = lambda p: lambda x: F.regexp_replace(x, f"^{p}", "")
    tries = [("NONE", "", same, 0), ("CASE_MISMATCH", "LOWER() or UPPER()", F.lower, 1), *[("PREFIX_MISMATCH", f"STRIP_PREFIX('{p}')", stripped(p), 2) for p in PREFIXES], ("PARTIAL_MATCH", "SUBSTRING or EXTRACT", lambda x: F.regexp_extract(x, r"([^-_/ ]+)$", 1), 3)]
    made = [overlap(value(a, column1, f), value(b, column2, f)).select(F.lit(k).alias("kind"), F.lit(t).alias("transformation"), "overlap_percent", F.lit(i).alias("i")) for k, t, f, i in tries]
    best = reduce(DataFrame.unionByName, made).orderBy(F.desc(F.col("overlap_percent") >= MEDIUM), "i", F.desc("overlap_percent"), "transformation").limit(1)
    return best.where((F.col("kind") != "NONE") & (F.col("overlap_percent") >= MEDIUM)).drop("i")


def fuzzy_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(exact_matches, fuzzy_matches, overlap_percent) of two tables of distinct values."""
    exact, n2 = overlap(a, b), b.agg(F.count("*").alias("n2"))
    fuzzy, n1 = fuzzy_matches(a, b).agg(F.count("*").alias("fuzzy_matches")), a.agg(F.count("*").alias("n1"))
    one = exact.select("exact_matches").join(F.broadcast(fuzzy)).join(F.broadcast(n1)).join(F.broadcast(n2))  # one row each
    return one.select("exact_matches", "fuzzy_matches", F.round((F.col("exact_matches") + F.col("fuzzy_matches")) * 100.0 / F.least("n1", "n2"), 4).alias("overlap_percent"))


def entity(table: Column, columns: Column | None = None) -> Column:
    """The business entity that a table's name suggests, else what its columns' names do: identifiers with dates and amounts are transactions, identifiers without dates master data."""
    out, name = None, F.lower(table)
    for kind, pattern in ENTITIES:
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    if columns is not None:
        some = lambda p: F.exists(columns, lambda c: F.lower(c).rlike(p))
        ids, dates = some("_id|id$"), some("date|time")
        out = out.when(ids & dates & some("amount|price|value"), "Transaction - Unknown Type").when(ids & ~dates, "Master Data - Unknown Type")
    return out.otherwise("Unknown Entity Type")


def report(relationships: DataFrame) -> DataFrame:
    """(confidence_level, n, warnings): relationships and warnings by level."""
    return relationships.groupBy("confidence_level").agg(F.count("*").alias("n"), F.sum(F.size("warnings")).alias("warnings"))


def business_summary(profiles: DataFrame, relationships: DataFrame) -> DataFrame:
    """(table, entity, key_columns, links): the entity of each table, its key candidates in order, and its relationships of HIGH or MEDIUM confidence."""
    of = profiles.groupBy("table").agg(F.array_sort(F.collect_list(F.when(F.col("primary_key_candidate"), F.col("column")))).alias("keys"), F.collect_list("column").alias("columns"))
    ends = relationships.where(F.col("confidence_level").isin("HIGH", "MEDIUM")).select(F.explode(F.array("source_table", "target_table")).alias("table"))
    links = ends.groupBy("table").agg(F.count("*").alias("links"))
    return of.join(F.broadcast(links), "table", "left").select("table", entity(F.col("table"), F.col("columns")).alias("entity"), F.array_join("keys", ",").alias("key_columns"), F.coalesce("links", F.lit(0)).alias("links"))


def suggested(joins: DataFrame, logical: DataFrame) -> DataFrame:
    """(source_table, source_column, target_table, target_column, detection_method) of a workbook's joins and logical relationships, each once."""
    a = joins.select(F.col("left_table").alias("source_table"), F.col("left_column").alias("source_column"), F.col("right_table").alias("target_table"), F.col("right_column").alias("target_column"))
    b = logical.select(F.col("from_table").alias("source_table"), F.col("from_column").alias("source_column"), F.col("to_table").alias("target_table"), F.col("to_column").alias("target_column"))
    return a.unionByName(b).distinct().withColumn("detection_method", F.lit("WORKBOOK"))
