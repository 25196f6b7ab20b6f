import numpy as np
import pytest

from sparkscope.llm import embedding_dedup
from sparkscope.llm.embedding_dedup import SPREAD, embedding_components
from tests.llm.test_simhash import components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n long"


def brute(rows, cosine=0.93):
    keep = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in keep:
        for b in keep:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a, b))
    groups = components(range(len(rows)), links)
    least = {}
    for k, g in groups.items():
        least.setdefault(g, []).append(rows[k][0])
    n = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    return sorted(((r[0], int(n[k]), m := min((i for i in least[groups[k]] if i is not None), default=None), r[0] == m or r[0] is None) for k, r in enumerate(rows)), key=str)


def rows_of(r, n, dim):
    centres = r.normal(size=(6, dim))
    out = [(i, (centres[i % 6] + 0.25 * r.normal(size=dim)).tolist(), int(i % 3)) for i in range(n)]
    out += [(n + i, r.normal(size=dim).tolist(), 1) for i in range(n // 2)]
    out += [(2 * n + i, out[4][1], out[4][2]) for i in range(20)]  # equal vectors
    return out


def test_rows_are_united_as_one_by_one():
    r = np.random.default_rng(5)
    for n, m in ((1, 0), (2, 3), (60, 30), (300, 260), (500, 4000)):
        a, b = r.integers(0, n, size=m), r.integers(0, n, size=m)
        roots = np.arange(n)
        for s in range(0, m, 50):  # in parts, as blocks are searched
            roots = embedding_dedup._united(roots, a[s : s + 50], b[s : s + 50])
        groups, least = components(range(n), list(zip(a.tolist(), b.tolist()))), {}
        for i in range(n):
            least.setdefault(groups[i], i)
        assert roots.tolist() == [least[groups[i]] for i in range(n)]


@pytest.mark.parametrize("dim", [8, 64])
def test_matches_all_pairs_over_small_lists_and_blocks(spark, dim):
    rows = rows_of(np.random.default_rng(dim), 300, dim)
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], SCHEMA)
    # A spread that reaches R probes every list that can matter.
    got = embedding_components(df, spread=1e9, list_rows=40, block=32).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)
    usual = {x["vec_id"]: x["n_links"] for x in embedding_components(df, spread=SPREAD, list_rows=40, block=64).collect()}
    want = {x[0]: x[1] for x in brute(rows)}
    assert sum(usual.values()) >= 0.98 * sum(want.values()) and all(usual[i] <= want[i] for i in want)


def test_unsound_vectors_stand_alone(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [2.0, 4.0, 6.0], 1), (11, [1.0, 2.0], 1), (12, v, 2), (2, v, 1), (None, v, 3)]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], SCHEMA)
    assert sorted((tuple(x) for x in embedding_components(df).collect()), key=str) == brute(rows)
    assert embedding_components(df.limit(0)).collect() == []
    assert [tuple(x) for x in embedding_components(df.where("vec_id = 4")).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("list_rows", [1, 40])
def test_low_rank_vectors_over_thousands_of_lists_lose_no_link(spark, list_rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_OF_LIST", 1)
    r = np.random.default_rng(3)
    x = r.normal(size=(2200, 4)) @ r.normal(size=(4, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = x @ x.T >= 0.93
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    got = {row["vec_id"]: row["n_links"] for row in embedding_components(df, list_rows=list_rows).collect()}
    assert got == want
