import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkscope.llm import search
from sparkscope.llm.search import Best, Shard, rank_documents

SCHEMA = "doc_id long, text string, rank string, id int, score int, item int"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def case(n=400):
    r = random.Random(2)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(600)] + ["Ñandú", "ÄB", "x9"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(int(r.paretovariate(0.7)) + 1))[:20_000]) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)]  # copies: equal scores
    docs += [(5, docs[5][1]), (5, "w1 w2"), (None, "w3 w1"), (None, None), (2000, None), (2001, ""), (2002, " .,- \n"), (2003, "w1 " * 50_000), (2004, "W1,w2;ÄB äb")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (103, "nobody has this"), (104, "w1 w1 W1"), (104, "w1 w1 W1"), (104, "x9"), (None, "ñandú Ñandú"), (105, docs[3][1])]
    return docs, items


def made(spark, docs):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in docs], SCHEMA)


@pytest.mark.parametrize(("parts", "k", "options"), [(1, 50, {}), (5, 50, {"shard_docs": 16}), (3, 3, {"shard_docs": 64}), (2, 1, {"block_bytes": 900}), (2, 100_000, {})])
def test_matches_brute_force_for_any_shards_and_blocks(spark, parts, k, options):
    docs, items = case()
    got = rank_documents(made(spark, docs).repartition(parts), spark.createDataFrame(items, "item_id long, text string"), k=k, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, k)


def test_empty_tables_and_text_ids(spark):
    docs, items = case(50)
    df, asked = made(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert rank_documents(df.limit(0), asked).collect() == [] == rank_documents(df, asked.limit(0)).collect()
    assert rank_documents(df.where("text is null"), asked).collect() == []
    assert rank_documents(df, asked.where("item_id = 102")).collect() == []
    got = rank_documents(df.selectExpr("cast(doc_id as string) as name", "text as body"), asked.selectExpr("cast(item_id as string) as item_id", "text"), id_col="name", text_col="body")
    assert got.columns == ["item_id", "rank", "name", "score"] and got.where("name = '2003'").count() > 0


def test_non_essential_lists_are_only_probed(monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    r = np.random.default_rng(1)
    n, dfs = 400, [400, 300, 30, 5]
    docs = np.concatenate([np.sort(r.permutation(n)[:d]) for d in dfs]).astype(np.int32)
    shard = Shard(r.integers(5, 50, size=n), np.arange(4, dtype=np.int32), np.array(dfs), docs, r.integers(1, 4, size=len(docs)).astype(np.int32), np.array([1, 20, 900, 4000]), n, 10_000)
    want = np.zeros(n, dtype=np.int64)
    np.add.at(want, shard.docs, shard.adds)
    best, read = Best(5), []
    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append((key.stop or 0) - (key.start or 0))
            return super().__getitem__(key)
    shard.adds = shard.adds.view(Counted)
    shard.search(np.arange(4), best, list(range(n)))
    assert [(-s, d) for s, _, d in best.rows] == sorted(((int(s), i) for i, s in enumerate(want)), key=lambda x: (-x[0], x[1]))[:5]
    assert sum(read) < 0.6 * len(docs)


def test_best_keeps_equal_scores_by_document():
    best = Best(3)
    best.offer(np.array([5, 7, 5, 5]), np.arange(4), [4, None, 9, 2])
    assert best.rows == [(-7, True, 0), (-5, False, 2), (-5, False, 4)] and best.least == 5
    best.offer(np.array([5, 4]), np.arange(2), [1, 0])
    assert [d for _, _, d in best.rows] == [0, 1, 2]
