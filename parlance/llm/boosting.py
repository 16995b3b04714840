"""Gradient-boosted trees for a 0/1 label on dense features, and isotonic calibration: small models that are fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    start: float
    feature: np.ndarray  # trees x inner nodes, in heap order
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32, least: float = 1.0) -> Trees:
    """Newton steps on the logistic loss over histograms of quantile bins."""
    n, d = x.shape
    p = (y.sum() + 1) / (n + 2)
    start = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(d)]
    cuts = [np.unique(np.concatenate([[0.0], c])) for c in cuts]  # most densities are zero nearly always
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    score = np.full(n, start)
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            count = 1 << level
            best, best_gain = np.zeros(count, np.int64), np.full(count, 1e-6)
            best_bin = np.full(count, width)
            for k in range(d):
                key = (at - first) * width + binned[:, k]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(cuts[k]) :] = 0
                b = gain.argmax(axis=1)
                better = gain[np.arange(count), b] > best_gain
                best[better], best_bin[better] = k, b[better]
                best_gain[better] = gain[np.arange(count), b][better]
            for i in range(count):
                if best_bin[i] < width:
                    feature[t, first + i], cut[t, first + i] = best[i], cuts[best[i]][best_bin[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        k = at - inner
        leaf[t] = rate * np.bincount(k, g, leaves) / (np.bincount(k, h, leaves) + ridge)
        score += leaf[t, k]
    return Trees(start, feature, cut, leaf)


@dataclass
class Isotonic:
    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        """Probabilities, linear between the blocks, with a small part of the score's own order left in."""
        own = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return 0.99 * np.interp(score, self.x, self.y) + 0.01 * own


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators; equal scores are one block."""
    values, inverse = np.unique(score, return_inverse=True)
    if not len(values):
        return Isotonic(np.array([-4.0, 4.0]), np.array([0.02, 0.98]))
    weight = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, y).astype(float)
    blocks: list[list[float]] = []  # weight, sum, first, last
    for w, s, v in zip(weight, total, values):
        blocks.append([w, s, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, hi = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][3] = hi
    x, p = [], []
    for w, s, lo, hi in blocks:
        q = (s + 0.5 * (s > 0)) / (w + 0.5) if s < w else (s + 0.5) / (w + 0.5 + 0.1)
        x += [lo, hi] if hi > lo else [lo]
        p += [min(q, 0.999)] * (2 if hi > lo else 1)
    return Isotonic(np.array(x), np.maximum.accumulate(np.array(p)))
