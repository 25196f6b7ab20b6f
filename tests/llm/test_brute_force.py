"""Toxicity and quality against plain loops, and pipeline stages over odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkscope.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, carried string"


def step(x, xs, ys):
    """Linear between the steps, flat beyond them."""
    if x <= xs[0]:
        return ys[0]
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        if x <= b:
            return q if x == b else p + (q - p) * (x - a) / (b - a)
    return ys[-1]


def test_toxicity_scores_follow_from_the_trees_and_counts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0}
    assert (model.lexicon.toxic, model.lexicon.other) == (sum(y.values()), len(y) - sum(y.values()))
    for term, (pos, neg) in list(model.lexicon.counts.items())[::7]:
        has = [i for i in y if any(term in toxicity.terms(w) for w in toxicity.words(text[i] or ""))]
        assert (pos, neg) == (sum(y[i] for i in has), sum(1 - y[i] for i in has))
    for r in toxicity.scored(docs, model, 5, 0).collect():
        x = toxicity.features(text[r["doc_id"]], model.lexicon)
        raw = model.trees.start
        for feature, cut, leaf in zip(model.trees.feature, model.trees.cut, model.trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > cut[node])
            raw += leaf[node - len(feature)]
        want = min(1, max(0, 0.99 * step(raw, model.level.x, model.level.y) + 0.01 / (1 + np.exp(-raw))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_scores_follow_from_the_field(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model, 3, 1).collect()}
    for r in docs.collect():
        x, n = quality.line_features(r["text"])
        if len(x) > 60:
            continue
        codes, w = model.field.codes(x), model.field.weights
        e = [sum(w[1, j, codes[t, j]] + (w[0, j, codes[t - 1, j]] if t else 0) + (w[2, j, codes[t + 1, j]] if t + 1 < len(x) else 0) for j in range(x.shape[1])) for t in range(len(x))]
        a, b = [np.array([0.0, e[0]])], [np.zeros(2)]
        for t in range(1, len(x)):
            a.append(np.array([0, e[t]]) + np.logaddexp(a[-1][0] + model.field.transition[0], a[-1][1] + model.field.transition[1]))
        for t in range(len(x) - 1, 0, -1):
            b.insert(0, np.array([np.logaddexp(model.field.transition[s, 0] + b[0][0], model.field.transition[s, 1] + e[t] + b[0][1]) for s in (0, 1)]))
        p = [1 / (1 + np.exp((u + v)[0] - (u + v)[1])) for u, v in zip(a, b)]
        mean = sum(q * (k + 1) for q, k in zip(p, n)) / sum(k + 1 for k in n)
        assert abs(got[r["doc_id"]] - min(1, max(0, 0.99 * step(mean, model.level.x, model.level.y) + 0.01 * mean))) < 1e-6


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (7, ""), (7, "unlike the other"), (7, "unlike the other"), (8, "x " * 50_000)], "doc_id long, text string")
    docs = some.select("doc_id", "text").unionByName(odd).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"), ("score", "double"), ("predicted", "int"), ("carried", "string"))])
    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            made = stage(spark, df, sf_dir)
            rows, before = made.collect(), df.collect()
            if k < 4:
                assert made.columns == df.columns and len(rows) <= len(before) and {tuple(r) for r in rows} <= {tuple(r) for r in before}
            else:
                assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["start"] == 0 for r in rows) == len(before)
        if k == 2:
            kept = {(r["doc_id"], r["text"]) for r in stage(spark, docs, sf_dir).collect()}
            assert (7, "unlike the other") in kept and any(t == "x " * 50_000 for _, t in kept)
