"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, their closeness to second-person words, capitals,
punctuation, obfuscated words. The learned lexicon holds words and word beginnings that are frequent in toxic documents; it,
the trees and the calibration are fitted on at most SAMPLE labelled documents, chosen by a hash of doc_id, of the folds that
are not held out. A training document's own share is taken out of the lexicon when its features are made, and calibration
uses trees that haven't seen the document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .common import fold_of, map_batches, staged, table

#: Labelled documents used for training at most, and documents the smallest useful training set has.
SAMPLE, LEAST_SAMPLE = 12_000, 20
FOLDS, HELD_OUT = 5, 0
#: Terms kept in the learned lexicon, toxic documents that must hold one, least log-odds, lengths of word beginnings.
TERMS, LEAST_DOCS, LEAST_WEIGHT, STEMS = 3000, 3, 1.5, (4, 5, 6, 7)
#: Bytes of words whose weights a worker keeps; each entry counts ENTRY more.
KEPT, ENTRY = 40 << 20, 100

# Common English insults and second-person words of four languages.
INSULTS = "clown coward creep disgusting dumb dumbass fool freak garbage hate idiot imbecile jerk kill liar loser lunatic moron moronic pathetic pig psycho retard scum scumbag shut sick stupid trash ugly vermin vile worthless".split()
SECOND_PERSON = "you your yours yourself youre u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tus usted ustedes vosotros".split()
LEET = str.maketrans("013457@$!|", "oleastasil")

_INSULTS, _YOU = {w.encode() for w in INSULTS}, {w.encode() for w in SECOND_PERSON}
_SPLIT = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_MIXED = re.compile(r"[A-Za-z]+(?:[0-9@$!|*._-]+[A-Za-z]+)+")
_SPACED = re.compile(r"\b(?:[A-Za-z] ){3,}[A-Za-z]\b")
_LOWER, _UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

FEATURES = ["insults", "insults_log", "learned", "learned_log", "learned_max", "learned_sum", "second_person", "close", "capitals", "capital_words", "exclamations", "questions", "marks", "obfuscated", "obfuscated_insults", "length", "distinct"]


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def terms(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) > n]]


class Lexicon:
    """Weights of learned terms: log-odds of a document with the term being toxic. counts: (toxic, other) documents by term."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], toxic: int, other: int):
        self.counts, self.toxic, self.other = counts, toxic, other
        self.known: dict[bytes, float] = {}
        self.held = 0

    def weight(self, pos: int, neg: int, label: int | None) -> float:
        """label: of the document at hand where it is one of those counted."""
        p, n = self.toxic, self.other
        if label is not None:
            pos, neg, p, n = pos - label, neg - (1 - label), p - label, n - (1 - label)
        if pos < LEAST_DOCS - (label is not None):
            return 0.0
        w = float(np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1)))
        return w if w >= LEAST_WEIGHT else 0.0

    def of(self, word: bytes, label: int | None = None) -> float:
        if label is not None:
            return max((self.weight(*c, label) for t in terms(word) if (c := self.counts.get(t))), default=0.0)
        w = self.known.get(word)
        if w is None:
            self.held += len(word) + ENTRY
            if self.held >= KEPT:
                self.known.clear()
                self.held = len(word) + ENTRY
            w = self.known[word] = max((self.weight(*c, None) for t in terms(word) if (c := self.counts.get(t))), default=0.0)
        return w


def features(text: str | None, lexicon: Lexicon, label: int | None = None) -> list[float]:
    """The values of FEATURES; zeros for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    raw, found = text.encode(), words(text)
    n = max(1, len(found))
    distinct = set(found)
    own = {w: v for w in distinct if (v := lexicon.of(w, label))}
    insults = distinct & _INSULTS
    bad = insults | own.keys()
    hits = [i for i, w in enumerate(found) if w in bad] if bad else []
    n_insults = sum(found[i] in insults for i in hits)
    n_own = sum(found[i] in own for i in hits)
    you = [i for i, w in enumerate(found) if w in _YOU] if distinct & _YOU else []
    close = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        y = np.array([-100, *you, 10**9])
        close = int((np.minimum(np.array(hits) - y[at], y[np.minimum(at + 1, len(y) - 1)] - np.array(hits)) <= 3).sum())
    lower, upper = (len(raw) - len(raw.translate(None, s)) for s in (_LOWER, _UPPER))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    capital_words = sum(w.isupper() and len(w) > 2 for w in text.split())
    mixed = [m.group().translate(LEET) for m in _MIXED.finditer(text)] if marks else []
    mixed += [m.group().replace(" ", "") for m in _SPACED.finditer(text)]
    plain = [re.sub(r"[^a-z]", "", m.lower()).encode() for m in mixed]
    n_plain = sum(p in _INSULTS or bool(lexicon.of(p, label)) for p in plain)
    total = sum(own[found[i]] for i in hits if found[i] in own)
    return [
        n_insults / n, np.log1p(n_insults), n_own / n, np.log1p(n_own), max(own.values(), default=0.0), np.log1p(total), len(you) / n, close / n, upper / max(1, upper + lower),
        capital_words / n, raw.count(b"!") / n, raw.count(b"?") / n, marks / len(raw), len(mixed) / n, np.log1p(n_plain), np.log1p(n), len(distinct) / n,
    ]


class Model:
    """score(texts) gives each text's calibrated probability of being toxic."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon, self.prior, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if len(y) < LEAST_SAMPLE or not 0 < self.prior < 1:
            return
        unseen = np.zeros(len(y))
        for k in range(5):
            out = np.arange(len(y)) % 5 == k
            unseen[out] = Trees().fit(x[~out], y[~out]).raw(x[out])
        self.trees, self.level = Trees().fit(x, y), Isotonic().fit(unseen, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]))
        # A small share of the trees' own order parts texts on the same step.
        return np.clip(0.99 * self.level(raw) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(text, y) of at most that many labelled documents outside the held-out fold, by a hash of doc_id.

    Ids with several labels take the largest; of several documents with one id the smallest text counts, so no more rows than ids come out.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (fold_of("_id", folds) != held_out)).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)  # most rows of two numbers: small enough to broadcast
    return docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    """Trains on docs (doc_id, text) and labels (doc_id, toxic). Without labels of both kinds every score is their mean, or 0 without any."""
    rows = staged(training_rows(docs, labels, "toxic", folds, held_out, sample), "toxicity-training")

    def count(batches):
        pos, neg = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (pos if y else neg).update({t for w in {*words(text or "")} for t in terms(w)})
        # Only terms of a toxic document can enter the lexicon, but this task may hold just the other documents of one.
        keys = [*pos.keys() | neg.keys()]
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([pos[k] for k in some], pa.int64()), pa.array([neg[k] for k in some], pa.int64())], ["term", "pos", "neg"])

    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = kinds.get(1, 0), kinds.get(0, 0)
    counted = map_batches(rows, count, "term binary, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    best = counted.where(F.col("pos") >= LEAST_DOCS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "term").limit(TERMS).collect()
    lexicon = Lexicon({bytes(r["term"]): (r["pos"], r["neg"]) for r in best}, p, n)

    def make(batches):
        for b in batches:
            y = b.column(1).to_pylist()
            x = [features(t, lexicon, k) for t, k in zip(b.column(0).to_pylist(), y)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    made: pd.DataFrame = map_batches(rows, make, "x array<double>, y int").toPandas()
    made = made.sample(frac=1, random_state=0) if len(made) else made
    return Model(lexicon, np.array(made["x"].tolist()).reshape(-1, len(FEATURES)), made["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model, folds: int, held_out: int, extra: list[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the extra columns of each row; model has score(texts)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = docs.select("doc_id", *extra).schema

    def run(batches):
        for b in batches:
            s = sent.value.score(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[1:], "score", "predicted"])

    held = F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("text").cast("string").alias("_text"), held, "doc_id", *extra)
    made = map_batches(rows, run, ", ".join(["held_out boolean", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "score double", "predicted int"]))
    return made.select("doc_id", "held_out", "score", "predicted", *extra)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts are scored by zeros as features; null doc_ids are not held out; repeated rows score alike; other columns play no part."""
    return scored(docs, fit(docs, labels), FOLDS, HELD_OUT)


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with docs' columns."""
    return kept_where(docs, fit(docs, labels), lambda s: s < 0.5)


def kept_where(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of docs whose score passes keep, in one pass without a shuffle."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays(b.columns, schema=b.schema).filter(pa.array(keep(sent.value.score(texts))))

    return map_batches(docs, run, docs.schema)


def op1(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
