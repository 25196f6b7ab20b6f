import random

import numpy as np
import pytest
import xxhash

from sparkscope.llm import line_dedup
from sparkscope.llm.line_dedup import dedup_lines, key_of, suspects, twice_filter

SCHEMA = "doc_id long, text string, kept string, id int, n_lines int, mark int"


def brute(rows, least=40, docs=5):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        gone = lambda k: len(k) >= least and len(holders[k]) >= docs and i != max((x for x in holders[k] if x is not None), default=None)  # noqa: B023, E731
        kept = [x for x in parts if not gone(key(x))]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in rows], SCHEMA)


def case():
    r = random.Random(4)
    lines = [f"Line {k} of some length, which is the key of a frequent one é{k}"[: 38 + k] + "x" for k in range(12)]
    lines += [f"  \t{lines[11].upper()}\x0b", "ä" * 39, "Ä" * 40, "É" + "b" * 39, "", " " * 60, "short"]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.5 else f"a line that nobody else has, number {i} {j} {r.random()}" for j in range(r.randrange(6)))) for i in range(60)]
    rows += [(100 + i, lines[10] + "\n" + lines[10] + "\r\n" + lines[10]) for i in range(40)]  # a line with a third of all rows
    rows += [(7, rows[7][1]), (7, lines[9]), (None, lines[8]), (None, lines[8]), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, (lines[11] + "\n") * 5000), (204, "z" * 200_000)]
    return rows + [(None, "null ids alone hold this line of forty characters")] * 6


@pytest.mark.parametrize(("parts", "options"), [(1, {}), (6, {}), (6, {"small": 0}), (3, {"small": 0, "least_docs": 2, "least_chars": 5}), (4, {"least_docs": 1})])
def test_matches_brute_force_on_both_ways_back(spark, parts, options):
    rows = case()
    got = dedup_lines(made(spark, rows).repartition(parts), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, options.get("least_chars", 40), options.get("least_docs", 5))


def test_small_full_filters_and_handed_on_ones_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_HASHES", 50)
    monkeypatch.setattr(line_dedup, "BATCH_ROWS", 7, raising=False)
    rows = case()
    got = dedup_lines(made(spark, rows).repartition(2), most_bits=20).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_suspects_are_all_repeated_keys_and_hardly_any_other(spark, tmp_path):
    rows = [(i, f"this line number {i} is of the length needed, and alone\nthis line number {i % 500} has another document") for i in range(3000)]
    df = made(spark, rows).select("id", "text", "mark").selectExpr("cast(id as long) as id", "text", "cast(mark as long) as mark").repartition(5)
    path = f"file://{tmp_path}/filters"
    twice_filter(df, 22, 20, path)
    keys = [bytes(r["key"]) for r in suspects(df, path, 22, 20).collect()]
    repeated = {key_of(t.split("\n")[1], 20) for _, t in rows}
    assert sorted(k for k in keys if k in repeated) == sorted(key_of(t.split("\n")[1], 20) for _, t in rows)
    assert len(keys) < 3000 + 30


def test_positions_spread_over_segments_and_bits():
    h = np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(20_000)], dtype=np.uint64)
    segment, place = line_dedup.positions(h, 24)
    assert np.bincount(segment, minlength=16).min() > 1000 and place.min() >= 0 and place.max() < 1 << 20
    assert len(np.unique(place)) > 70_000


def test_further_columns_and_empty_tables(spark):
    df = made(spark, case())
    got = dedup_lines(df, carry=df.columns)
    assert got.select("carried.*").columns == df.columns and got.select("carried.*").exceptAll(df).count() == 0
    assert dedup_lines(df, carry=["mark"], small=0).count() == df.count()
    assert dedup_lines(df.limit(0)).collect() == []
    assert [tuple(r) for r in dedup_lines(made(spark, [(1, None), (2, "")])).collect()] == [(1, 1, 0, ""), (2, 1, 0, "")]
