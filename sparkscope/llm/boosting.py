"""Gradient-boosted trees on small dense feature tables, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Binary classification: complete trees of a fixed depth over quantile bins, Newton steps on the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 2.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        width = self.bins + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw, nodes = np.full(n, self.start), (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((self.rounds, nodes), dtype=int), np.full((self.rounds, nodes), np.inf), np.zeros((self.rounds, 1 << self.depth))
        for r in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h, at = y - prob, prob * (1 - prob), np.zeros(n, dtype=int)
            for level in range(self.depth):
                k, first = 1 << level, (1 << level) - 1
                slot = ((at[:, None] * f + np.arange(f)) * width + codes).ravel()
                sums = [np.bincount(slot, weights=np.repeat(w, f), minlength=k * f * width).reshape(k, f, width).cumsum(axis=2) for w in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                top, (bf, bc) = gain.reshape(k, -1).max(axis=1), np.divmod(best, width)
                for i in range(k):
                    if top[i] > 1e-9 and bc[i] < len(self.edges[bf[i]]):
                        self.feature[r, first + i], self.cut[r, first + i] = bf[i], self.edges[bf[i]][bc[i]]
                at = 2 * at + (x[np.arange(n), self.feature[r, first + at]] > self.cut[r, first + at])
            gs, hs = np.bincount(at, weights=g, minlength=1 << self.depth), np.bincount(at, weights=h, minlength=1 << self.depth)
            self.leaf[r] = self.rate * gs / (hs + self.penalty)
            raw += self.leaf[r][at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=int)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            total += leaf[at]
        return total


class Isotonic:
    """A non-decreasing step fit by pooling adjacent violators, linear between the steps' means."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []  # weight, sum of y, sum of s
        for a, b in zip(s[order].tolist(), y[order].tolist()):
            pools.append([1.0, b, a])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last)]
        self.x = np.array([p[2] / p[0] for p in pools])
        self.y = np.array([(p[1] + 0.5 * y.mean()) / (p[0] + 0.5) for p in pools])  # drawn a little to the mean
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y)
