"""Gradient-boosted trees on binned features, small enough to fit in one task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth as arrays: feature and border of each inner node, value of each leaf."""

    def __init__(self, bias: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.bias, self.trees = bias, trees
        self.feature, self.border, self.value = (np.stack([t[i] for t in trees]) for i in range(3))

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all trees go down one level at a time."""
        tree = np.arange(len(self.trees))
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        at = np.zeros((len(x), len(tree)), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.border[tree, at])
        return self.bias + self.value[tree, at - inner].sum(1)


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 40, depth: int = 4,
    rate: float = 0.25, bins: int = 32, smooth: float = 1.0,
) -> Boosted:
    """Log loss with second-order leaf values; each level of a tree splits all its nodes at once."""
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)]
    raw, trees, inner = np.full(len(y), bias), [], 2**depth - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            best = np.full(n, 1e-6)
            whole = np.bincount(local, g, n) ** 2 / (np.bincount(local, h, n) + smooth)
            cut = np.full(n, -1)
            for f, b in enumerate(borders):
                size = len(b) + 1
                if size < 2:
                    continue
                cell = local * size + binned[f]
                gl = np.bincount(cell, g, n * size).reshape(n, size).cumsum(1)
                hl = np.bincount(cell, h, n * size).reshape(n, size).cumsum(1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - whole[:, None]
                gain = gain[:, :-1]
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best = np.where(better, gain[np.arange(n), top], best)
                feature[first : first + n] = np.where(better, f, feature[first : first + n])
                border[first : first + n] = np.where(better, b[np.minimum(top, len(b) - 1)], border[first : first + n])
                cut = np.where(better, top, cut)
            went = np.zeros(len(y), bool)
            for f in np.unique(feature[first : first + n]):
                mine = (feature[at] == f) & (cut[local] >= 0)
                went[mine] = binned[f][mine] > cut[local[mine]]
            at = 2 * at + 1 + went
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        raw += value[leaf]
        trees.append((feature, border, value))
    return Boosted(bias, trees)
