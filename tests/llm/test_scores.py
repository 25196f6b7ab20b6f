import zlib

import numpy as np
import pytest

from sparkscope.llm import quality, toxicity
from sparkscope.llm.boosting import Isotonic, Trees

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_trees_and_calibration_learn_and_stay_in_bounds():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    raw = Trees(rounds=40).fit(x[:1000], y[:1000]).raw(x[1000:])
    assert auc(y[1000:], raw) > 0.98
    p = Isotonic().fit(raw, y[1000:])(np.sort(raw))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() <= p.max() <= 1


@pytest.mark.parametrize(("op", "target", "folds", "held"), [(toxicity.toxicity, "toxic", 5, 0), (quality.quality, "quality", 3, 1)])
def test_held_out_documents_are_ranked_well(spark, op, target, folds, held):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = op(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert all((zlib.crc32(str(d).encode()) % folds == held) == h for d, h in zip(got["doc_id"], got["held_out"]))
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert auc(m[target].to_numpy(), m["score"].to_numpy()) > 0.9


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_odd_rows_and_missing_labels(spark, op):
    texts = [None, "", " \n\n ", "x", "x", "word " * 200_000, "\n" * 3000, "YOU IDIOT! y0u 1d10t i d i o t", "ñ é 日本", "|" * 1000]
    rows = [(i if i != 3 else None, t, "en", 0.1, "z") for i, t in enumerate(texts)] + [(4, "x", "de", 0.2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op(docs, none).collect()
    assert len(got) == len(rows) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1000, 1060)] + [(None, 1, 1), (2, None, None), (1000, 1, 1)], none.schema)
    taught = docs.unionByName(spark.createDataFrame([(i, ("stupid fool! " if i % 2 else "a calm line.\n") * 30, "en", 0.0, "") for i in range(1000, 1060)], docs.schema))
    got = op(taught, labels).toPandas()
    assert len(got) == len(rows) + 60 and got["score"].between(0, 1).all()
    assert not got["held_out"][got["doc_id"].isna()].any()
    seen = got[got["doc_id"] >= 1000]
    assert seen[seen["doc_id"] % 2 == 1]["score"].min() > seen[seen["doc_id"] % 2 == 0]["score"].max()
    assert op(docs.limit(0), labels).collect() == []


def test_filters_keep_columns_and_drop_the_rejected(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    for keep, score in ((toxicity.not_toxic, toxicity.toxicity), (quality.good_documents, quality.quality)):
        kept = keep(docs, labels)
        assert kept.columns == docs.columns
        wanted = score(docs, labels).where("predicted = " + ("0" if keep is toxicity.not_toxic else "1"))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in wanted.collect())


def test_marginals_match_all_labellings():
    r = np.random.default_rng(4)
    lengths = [3, 1, 5]
    e, t = r.normal(size=9), r.normal(size=(2, 2))
    got, pairs = quality.marginals(e, t, quality.Chains(lengths))
    at, want, want_pairs = 0, np.zeros(9), np.zeros((2, 2))
    for n in lengths:
        total, own, own_pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            s = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] for i in range(n) if s[i]) + sum(t[a, b] for a, b in zip(s, s[1:])))
            total += w
            own += w * np.array(s)
            for a, b in zip(s, s[1:]):
                own_pairs[a, b] += w
        want[at : at + n] = own / total
        want_pairs += own_pairs / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_repeated_words_count_in_lines_of_many_words():
    others = " ".join(f"w{i}" for i in range(30))
    lines = ["spam " * 300 + others, others, "", "a a b", "one"]
    x, _ = quality.line_features("\n".join(lines))
    got = x[:, quality.FEATURES.index("most_common")]
    assert np.allclose(got, [300 / 330, 1 / 30, 0, 2 / 3, 1])


def test_training_rows_keep_whole_texts_within_bounds(spark):
    rows = [("a\n" * k + "end", k % 2) for k in (0, 3, 5, 9, 200)] + [(None, 1), ("", 0), ("twice\nover", 1), ("twice\nover", 1)]
    df = spark.createDataFrame(rows, "text string, y int")
    assert sorted(map(str, quality.chosen_rows(df, 100, 10_000).collect())) == sorted(map(str, df.where("text is null or length(text) < 300").collect()))
    some = quality.chosen_rows(df, 100, 15).collect()
    assert 0 < len(some) < len(rows) - 1 and sum((r["text"] or "").count("\n") + 1 for r in some) <= 15
    assert sorted(map(str, quality.chosen_rows(df.repartition(3), 100, 15).collect())) == sorted(map(str, some))


def test_many_lines_are_laid_out_in_groups(monkeypatch):
    r = np.random.default_rng(1)
    texts = [*("\n".join("good words here." if k % 2 else "###|| !!" for _ in range(r.integers(1, 9))) for k in range(60)), None, "", "x\n" * 50_000]
    parts, y = [quality.line_features(t) for t in texts[:60]], np.array([k % 2 for k in range(60)], dtype=float)
    model = quality.Model(parts, y)
    want = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts), want)
    monkeypatch.setattr(quality, "TOGETHER", 40)
    assert [len(g) for g in quality._together(["a" * 30, "b" * 30, None, "c" * 100, "d"])] == [1, 2, 1, 1]
    assert np.allclose(model.score(texts), want)
