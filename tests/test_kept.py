"""Fuzzy values of many pairs of columns by one index, and discovery that goes on after a person's changes."""

import random
import shutil

import pytest

from sparkscope.functions.names import token_ratio
from sparkscope.operators.kept import KeptColumns
from sparkscope.operators.overlap import FUZZY, fuzzy_matches, fuzzy_pairs
from sparkscope.operators.relationships import discover


def texts(seed, n=45):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcde 19") for _ in range(rng.randrange(1, 25))) for _ in range(n)]
    made += ["Anna Maria Lopez", "CUST-001", "C", "  ", "", "Müller GmbH", "aaaaaaaaaa", "x y z"]

    def bent(s):
        out = list(s)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", " "])
        return "".join(out)

    return made, [bent(s) for s in made for _ in range(2)]


def alike(left, right):
    mine, theirs = set(left) - set(right), set(right) - set(left)
    return {a for a in mine if any(token_ratio(a, b) > FUZZY for b in theirs)}


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_pairs_of_columns_share_an_index(spark, hot):
    (a, b), (c, d) = texts(3), texts(4)
    columns = {("s", "x"): a, ("s", "y"): c + a[:9], ("t", "u"): b, ("t", "v"): d + [None]}
    rows = [(*k, v, 1) for k, vs in columns.items() for v in {*vs}]
    values = spark.createDataFrame(rows, "table string, column string, value string, n long")
    pairs = [(*k, *m) for k in columns for m in columns if k[0] < m[0]]
    asked = spark.createDataFrame(pairs, "table1 string, column1 string, table2 string, column2 string")
    got = {tuple(r)[:4]: r["fuzzy_matches"] for r in fuzzy_pairs(values, asked.union(asked), hot=hot).collect()}
    want = {p: len(alike(columns[p[:2]], [v for v in columns[p[2:]] if v is not None])) for p in pairs}
    assert got == {p: n for p, n in want.items() if n} and sum(want.values()) > 40
    assert fuzzy_pairs(values.limit(0), asked, hot=hot).collect() == []


def test_crowded_lengths_meet_by_two_characters(spark):
    a, b = texts(9)
    frame = lambda vs: spark.createDataFrame([(v,) for v in sorted({*vs})], "value string")
    assert {r["value"] for r in fuzzy_matches(frame(a), frame(b), hot=0).collect()} == alike(a, b)


def test_discovery_takes_values_that_are_nearly_alike(spark):
    names = [f"{x} works {y}" for x in ("north", "amber", "silver", "copper") for y in ("harbour", "quarry", "bridge", "meadow")]
    a = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "firm_name string, k int")
    b = spark.createDataFrame([(n + "s" if i % 4 else n, i + 900) for i, n in enumerate(names)], "firm_names string, z int")
    assert discover({"a": a, "b": b}).where("detection_method = 'FUZZY_VALUES'").collect() == []
    found = discover({"a": a, "b": b}, fuzzy=True).where("detection_method = 'FUZZY_VALUES'").collect()
    assert [(r["source_column"], r["target_column"], r["overlap_percent"], r["exact_matches"], r["orphans_in_source"], r["confidence_score"]) for r in found] == [("firm_name", "firm_names", 100.0, 4, 0, 75)]


def plain(df):
    return sorted(str(r) for r in df.collect())


def test_a_rerun_reads_no_table_again(spark, tmp_path):
    spark.range(300).selectExpr("id as cust_id", "concat('Name', id) as label", "id % 7 as grp").write.parquet(f"{tmp_path}/a")
    spark.range(500).selectExpr("id % 300 as customer_id", "id % 300 as cust_id", "concat('name', id % 300) as label", "id as serial").write.parquet(f"{tmp_path}/b")
    read = lambda: {t: spark.read.parquet(f"{tmp_path}/{t}") for t in "ab"}
    kept, tables = KeptColumns(read()), read()
    assert plain(discover(kept)) == plain(discover(tables))
    # What fresh runs give after each change, by the tables themselves.
    changed = {"dropped": {"a": tables["a"], "b": tables["b"].drop("cust_id")}, "renamed": {"a": tables["a"].withColumnRenamed("label", "labels"), "b": tables["b"].drop("cust_id").withColumnRenamed("customer_id", "cust_id")}}
    want = {k: plain(discover(v)) for k, v in changed.items()}
    for t in "ab":
        shutil.rmtree(tmp_path / t)  # whatever reads a table now, fails
    dropped = kept.dropped("b", "cust_id")
    assert plain(discover(dropped)) == want["dropped"]
    renamed = dropped.renamed("b", {"customer_id": "cust_id"}).renamed("a", {"label": "labels"})
    assert plain(discover(renamed)) == want["renamed"]
    assert dropped.scanned == renamed.scanned == [] and kept.scanned
    assert plain(discover(kept)) != want["renamed"]


def test_only_what_is_new_is_scanned(spark):
    a = spark.range(50).selectExpr("id as cust_id", "id as zone", "id + 7000 as qqq")
    b = spark.range(60).selectExpr("id as cust_id", "id as other_thing")
    kept = KeptColumns({"a": a, "b": b})
    discover(kept).collect()
    assert not {("a", "qqq"), ("b", "other_thing")} & {*kept.scanned}
    near = kept.renamed("b", {"other_thing": "zone"})
    assert {(r["source_column"], r["target_column"]) for r in discover(near).collect()} == {("cust_id", "cust_id"), ("zone", "zone")}
    assert {*near.scanned} == {("a", "zone"), ("b", "other_thing")}
    swapped = near.replaced("b", spark.range(50).selectExpr("id as cust_id"))
    assert len(discover(swapped).collect()) == 1 and {*swapped.scanned} == {("b", "cust_id")}
    assert len(discover(near).collect()) == 2
    for wrong in (lambda: kept.dropped("a", "nope"), lambda: kept.renamed("a", {"nope": "x"})):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        kept.renamed("a", {"zone": "cust_id"})
