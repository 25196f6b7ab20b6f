"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets features (lengths, capitals, symbols, bars, repetition) cut into bins; the score of a line being
good adds a weight for each bin of its own, the previous and the next line's features, and transitions tie neighbours. The
field is trained by its log-likelihood on lines that carry their document's label, over at most SAMPLE labelled documents of the
folds that are not held out, chosen by a hash of doc_id, with all their lines. Documents of more than LONGEST lines are not
chosen, nor those that come, in the order of a hash, when MOST_LINES lines have been chosen. Every line of every document is
scored. Forward-backward gives each line's marginal; the mean of the marginals, weighted by the lines' lengths, is calibrated to the
document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Isotonic
from .common import map_batches, staged, table
from .toxicity import kept_where, scored, training_rows

#: Labelled documents used for training at most, and those the smallest useful training set has.
SAMPLE, LEAST_SAMPLE = 6_000, 20
#: Lines of a training document, and of all of them, at most: 35 MB of features on the driver.
LONGEST, MOST_LINES = 20_000, 300_000
#: Bytes of texts whose lines are laid out together; a longer text is alone.
TOGETHER = 1 << 20
FOLDS, HELD_OUT = 3, 1
BINS, ROUNDS, RATE, PENALTY = 8, 120, 0.1, 1e-3

FEATURES = ["bytes", "words", "word_length", "capitals", "symbols", "bars", "exclamations", "digits", "stops", "distinct", "spread", "most_common", "same_lines", "ends_well"]

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOLS, _STOPS = b"#$%&*+/<=>@[\\]^_`{|}~", b".,;:?"


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES for each line, the lines' lengths in bytes); a text without line feeds is one line."""
    lines = (text or "").encode().split(b"\n")
    times: dict[bytes, int] = {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    out = []
    for line in lines:
        n, found = len(line), line.split()
        k, m = len(found), max(1, len(line))
        share = lambda s: (n - len(line.translate(None, s))) / m  # noqa: B023, E731
        counts = Counter(found)
        d, most = len(counts), max(counts.values(), default=0)
        upper, lower = share(_UPPER), share(_LOWER)
        out.append(
            (
                np.log1p(n), np.log1p(k), (n - k) / max(1, k), upper / max(1e-9, upper + lower), share(_SYMBOLS), line.count(b"|") / m, line.count(b"!") / m, share(_DIGITS), share(_STOPS) * m / max(1, k),
                d / max(1, k), np.log1p(d) / np.log1p(k) if k else 1.0, most / max(1, k), np.log1p(times[line] - 1), float(line[-1:] in (b".", b"?", b"!", b'"')),
            )
        )
    return np.array(out, dtype=np.float64).reshape(-1, len(FEATURES)), np.array([len(x) for x in lines], dtype=np.float64)


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, in groups of about TOGETHER bytes."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t or "") > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


class Chains:
    """Line sequences of some documents laid out by step, longest first, so that one numpy call serves all at a step."""

    def __init__(self, lengths: list[int]):
        n = np.array(lengths, dtype=int)
        self.order = np.argsort(-n, kind="stable")
        self.first = np.concatenate(([0], np.cumsum(n)[:-1]))[self.order]
        self.steps = int(n.max()) if len(n) else 0
        self.active = [int(k) for k in (len(n) - np.searchsorted(np.sort(n), np.arange(self.steps), side="right"))]

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def marginals(emission: np.ndarray, transition: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of state 1 for each line, expected transitions): emission is the log-score of state 1 against 0."""
    e = np.stack((np.zeros_like(emission), emission), axis=1)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    for t in range(chains.steps):
        i = chains.at(t)
        a = e[i] if t == 0 else e[i] + np.logaddexp(forward[i - 1, :1] + transition[0], forward[i - 1, 1:] + transition[1])
        forward[i] = a - np.logaddexp(a[:, :1], a[:, 1:])  # a constant a line changes no marginal
    pairs = np.zeros((2, 2))
    for t in range(chains.steps - 2, -1, -1):
        i = chains.at(t + 1) - 1
        b = e[i + 1] + backward[i + 1]
        joint = forward[i][:, :, None] + transition[None] + b[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = np.logaddexp(transition[:, 0][None] + b[:, :1], transition[:, 1][None] + b[:, 1:])
        backward[i] = back - np.logaddexp(back[:, :1], back[:, 1:])
    s = forward + backward
    return 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -500, 500))), pairs


class Field:
    """The conditional random field; weights by (previous, own, next line) x feature x bin."""

    def __init__(self):
        self.weights, self.transition = np.zeros((3, len(FEATURES), BINS)), np.zeros((2, 2))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def emission(self, codes: np.ndarray, chains: Chains) -> np.ndarray:
        before, own, after = (w[np.arange(len(FEATURES)), codes].sum(axis=1) for w in self.weights)
        out, inner = own.copy(), np.ones(len(own), dtype=bool)
        inner[chains.first] = False
        at = np.flatnonzero(inner)
        out[at] += before[at - 1]
        out[at - 1] += after[at]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, chains: Chains) -> Field:
        """y: the state of each line. Adam on the log-likelihood with an L2 penalty."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        codes = self.codes(x)
        inner = np.ones(len(x), dtype=bool)
        inner[chains.first] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        slot = np.arange(len(FEATURES)) * BINS + codes
        parameters = [self.weights, self.transition]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        for r in range(1, ROUNDS + 1):
            p, pairs = marginals(self.emission(codes, chains), self.transition, chains)
            miss = y - p
            sums = lambda rows, m: np.bincount(slot[rows].ravel(), weights=np.repeat(m, len(FEATURES)), minlength=len(FEATURES) * BINS).reshape(len(FEATURES), BINS)
            gradients = [np.stack((sums(at - 1, miss[at]), sums(slice(None), miss), sums(at, miss[at - 1]))) / len(x), (seen - pairs) / len(x)]
            for v, g, (m, s) in zip(parameters, gradients, state):
                g = g - PENALTY * v / 10
                m[:] = 0.9 * m + 0.1 * g
                s[:] = 0.99 * s + 0.01 * g * g
                v += RATE * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
        return self

    def document_means(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The length-weighted mean marginal of each document."""
        chains = Chains([len(x) for x, _ in parts])
        p, _ = marginals(self.emission(self.codes(np.concatenate([x for x, _ in parts])), chains), self.transition, chains)
        weight = np.concatenate([n + 1 for _, n in parts])
        starts = np.concatenate(([0], np.cumsum([len(x) for x, _ in parts])[:-1]))
        return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)


class Model:
    """score(texts) gives each text's calibrated probability of being good; line_marginals(text) that of each line."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        self.prior, self.field = float(y.mean()) if len(y) else 0.0, None
        if len(y) < LEAST_SAMPLE or not 0 < self.prior < 1:
            return
        unseen = np.zeros(len(y))
        for k in range(2):
            out = np.arange(len(y)) % 2 == k
            unseen[out] = self._trained([p for p, o in zip(parts, out) if not o], y[~out]).document_means([p for p, o in zip(parts, out) if o])
        self.field, self.level = self._trained(parts, y), Isotonic().fit(unseen, y)

    @staticmethod
    def _trained(parts, y) -> Field:
        return Field().fit(np.concatenate([x for x, _ in parts]), np.repeat(y, [len(x) for x, _ in parts]), Chains([len(x) for x, _ in parts]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.field is None or not texts:
            return np.full(len(texts), self.prior)
        mean = np.concatenate([self.field.document_means([line_features(t) for t in some]) for some in _together(texts)])
        # A small share of the field's own order parts texts on the same step.
        return np.clip(0.99 * self.level(mean) + 0.01 * mean, 0, 1)

    def line_marginals(self, text: str | None) -> np.ndarray:
        x, _ = line_features(text)
        if self.field is None:
            return np.full(len(x), self.prior)
        chains = Chains([len(x)])
        return marginals(self.field.emission(self.field.codes(x), chains), self.field.transition, chains)[0]


def chosen_rows(rows: DataFrame, longest: int, most: int) -> DataFrame:
    """Rows (text, y) of at most `longest` lines each, in the order of a hash of the text until `most` lines are reached. rows are SAMPLE at most."""
    counted = rows.withColumns({"mark": F.xxhash64("text"), "lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n"))}).where(F.col("lines") <= longest)
    upto = counted.groupBy("mark").agg(F.sum("lines").alias("lines")).select("mark", F.sum("lines").over(Window.orderBy("mark")).alias("upto"))
    return counted.join(F.broadcast(upto.where(F.col("upto") <= most)), "mark", "left_semi").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    """Trains on docs (doc_id, text) and labels (doc_id, quality). Without labels of both kinds every score is their mean, or 0 without any."""
    rows = chosen_rows(staged(training_rows(docs, labels, "quality", folds, held_out, sample), "quality-training"), LONGEST, MOST_LINES)

    def make(batches):
        for b in batches:
            made = [line_features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.ravel() for x, _ in made], pa.list_(pa.float64())), pa.array([n for _, n in made], pa.list_(pa.float64())), b.column(1)], ["x", "n", "y"])

    made = map_batches(rows, make, "x array<double>, n array<double>, y int").toPandas()
    made = made.sample(frac=1, random_state=0) if len(made) else made
    return Model([(np.asarray(x, dtype=float).reshape(-1, len(FEATURES)), np.asarray(n, dtype=float)) for x, n in zip(made["x"], made["n"])], made["y"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts are one empty line; null doc_ids are not held out; repeated rows score alike; other columns play no part."""
    return scored(docs, fit(docs, labels), FOLDS, HELD_OUT)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with docs' columns; without labels all stay."""
    model = fit(docs, labels)
    return docs if model.field is None else kept_where(docs, model, lambda s: s >= 0.5)


def op6(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
