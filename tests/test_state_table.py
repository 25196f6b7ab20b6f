"""Merges by key against a plain dictionary, versions, conflicts and cascades."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkscope.operators import state as S
from sparkscope.sources.state_table import Conflict, StateTable

SCHEMA = "k long, at long, a string, b long, gone boolean"


def applied(state, changes, partial):
    """What a merge makes of {key: row}, one change after the other in their order."""
    out = {k: dict(v) for k, v in state.items()}
    for k, at, a, b, gone in sorted(changes, key=lambda c: c[1]):
        if k in out and out[k]["at"] >= at:
            continue
        if gone:
            out.pop(k, None)
        elif partial:
            row = out.setdefault(k, {"a": None, "b": None})
            row |= {"at": at, "a": row["a"] if a is None else a, "b": row["b"] if b is None else b}
        else:
            out[k] = {"at": at, "a": a, "b": b}
    return out


@pytest.mark.parametrize("partial", [False, True])
def test_merges_match_a_dictionary_and_old_versions_stay(spark, tmp_path, partial):
    r, table, states = random.Random(6), StateTable(spark, f"file://{tmp_path}/t", ["k"], 8), [{}]
    clock = itertools.count(1)
    for _ in range(4):
        changes = [(r.choice([None, *range(20)]), next(clock), r.choice([None, "x", "y"]), r.choice([None, 1, 2]), r.random() < 0.2) for _ in range(25)]
        df = spark.createDataFrame(changes + changes[:5], SCHEMA).repartition(3)  # attempts are repeated
        n = table.merge(df, "at", "gone", partial)
        states.append(applied(states[-1], changes, partial))
        assert n == len(states) - 1
    for n, want in enumerate(states[1:], 1):
        got = {x["k"]: {"at": x["at"], "a": x["a"], "b": x["b"]} for x in table.read(n).collect()}
        assert got == want and table.read(n).count() == len(want)
    table.merge(df, "at", "gone", partial)  # the whole batch again, and an old one
    table.merge(df.where("at < 80"), "at", "gone", partial)
    assert {x["k"]: {"at": x["at"], "a": x["a"], "b": x["b"]} for x in table.read().collect()} == states[-1]


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    table = StateTable(spark, f"file://{tmp_path}/t", ["k"], 16)
    table.merge(spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("at")), "at")
    table.merge(spark.createDataFrame([(7, 2), (9, 2), (9, 3)], "k long, at int"), "at")
    assert 1 <= len(table.touched(2)) <= 2 and len(table.touched(1)) == 16
    assert table.read().where("at > 1").count() == 2 and table.read(1).where("at > 1").count() == 0
    assert table.merge(spark.createDataFrame([], "k long, at int"), "at") == 2
    rewritten = len(table.touched(2))
    assert table.forget(1) == rewritten and table.versions() == [2] and table.read().count() == 500
    with pytest.raises(ValueError):
        table.read(1)


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    table, df = StateTable(spark, f"file://{tmp_path}/t", ["k"], 4), spark.createDataFrame([(1, 1)], "k long, at int")
    other = StateTable(spark, table.folder, ["k"], 4)
    commit = StateTable._commit

    def late(self, v):
        if self is table:
            other.merge(spark.createDataFrame([(2, 1)], "k long, at int"), "at")
        return commit(self, v)

    monkeypatch.setattr(StateTable, "_commit", late)
    with pytest.raises(Conflict):
        table.merge(df, "at")
    assert [r["k"] for r in other.read().collect()] == [2]
    monkeypatch.undo()
    assert table.merge(df, "at") == 2 and table.read().count() == 2
    with pytest.raises(ValueError):
        StateTable(spark, table.folder, ["k"], 8).read()


def test_cascades_follow_every_reference(spark):
    r = random.Random(2)
    a = [(i, r.randrange(3)) for i in range(20)]
    b = [(i, r.choice([None, 99, *range(20)]), r.randrange(20)) for i in range(60)]
    c = [(i, r.randrange(60), r.choice([None, *range(20)])) for i in range(100)]
    tables = {"c": spark.createDataFrame(c, "id long, b long, a long"), "b": spark.createDataFrame(b, "id long, a long, a2 long"), "a": spark.createDataFrame(a, "id long, x long")}
    refs = [S.Reference("b", "a", "a", "id"), S.Reference("c", "b", "b", "id"), S.Reference("c", "a", "a", "id", "set null")]
    left = S.cascade(tables, refs, {"a": F.col("x") == 1, "b": F.when(F.col("id") % 7 == 0, True)})
    gone_a = {i for i, x in a if x == 1}
    gone_b = {i for i, x, _ in b if i % 7 == 0 or x in gone_a}
    assert sorted(tuple(x) for x in left["a"].collect()) == sorted(x for x in a if x[0] not in gone_a)
    assert sorted(map(str, (tuple(x) for x in left["b"].collect()))) == sorted(map(str, (x for x in b if x[0] not in gone_b)))
    assert sorted(map(str, (tuple(x) for x in left["c"].collect()))) == sorted(map(str, ((i, y, None if x in gone_a else x) for i, y, x in c if y not in gone_b)))
    with pytest.raises(ValueError):
        S.cascade(tables, [*refs, S.Reference("a", "x", "c", "id")], {"a": F.lit(True)})
    with pytest.raises(ValueError):
        S.cascade(tables, [S.Reference("b", "a", "a", "id", "restrict")], {"a": F.col("x") == 1})
    assert S.cascade(tables, [S.Reference("b", "a", "a", "id", "restrict")], {"a": F.col("id") > 1000})["b"].count() == 60
