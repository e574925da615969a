"""Gradient-boosted trees for the log loss, small enough to train on the driver
from a bounded sample; predictions run in numpy or as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Complete binary trees of one depth: the nodes of tree t split `feature[t, i]` at
    `cut[t, i]` (larger values go right) and its leaves add `leaf[t, j]` to the logit."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    @property
    def depth(self) -> int:
        return self.leaf.shape[1].bit_length() - 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out

    def column(self, features: list[Column]) -> Column:
        """The logit as a column of built-in expressions."""
        total = F.lit(self.start)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            total = total + self._branch(features, f, c, leaf, 0)
        return total

    def _branch(self, features: list[Column], f: np.ndarray, c: np.ndarray, leaf: np.ndarray, at: int) -> Column:
        if at >= len(f):
            return F.lit(float(leaf[at - len(f)]))
        left = self._branch(features, f, c, leaf, 2 * at + 1)
        if np.isinf(c[at]):
            return left
        return F.when(features[f[at]] > F.lit(float(c[at])), self._branch(features, f, c, leaf, 2 * at + 2)).otherwise(left)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Second-order boosting on quantile bins. One class only gives a constant."""
    n, m = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    start = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    logit, out = np.full(n, start), []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            gain, pick, where = np.zeros(width), np.zeros(width, int), np.full(width, np.inf)
            for j in range(m):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                key = local * k + binned[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                value = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                value[(hl < least) | (ht - hl < least)] = 0
                best = value.argmax(1)
                better = value[np.arange(width), best] > gain + 1e-9
                gain[better] = value[np.arange(width), best][better]
                pick[better], where[better] = j, edges[j][best[better]]
            feature[first : first + width], cut[first : first + width] = pick, where
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaves = at - inner
        leaf = -rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + ridge)
        logit += leaf[leaves]
        out.append((feature, cut, leaf))
    if not out:
        return Boosted(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    return Boosted(*(np.stack([o[i] for o in out]) for i in range(3)), start)


def threshold(logits: np.ndarray, y: np.ndarray, precision: float = 0.95) -> float:
    """The lowest logit from which on at least `precision` of held-back rows are
    positive; infinite where there is none."""
    order = np.argsort(-logits, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[logits[order][1:] < logits[order][:-1], True] if len(y) else np.zeros(0, bool)  # never between equal logits
    ok = np.flatnonzero((right >= precision) & last)
    return float(logits[order][ok[-1]]) if len(ok) else float("inf")
