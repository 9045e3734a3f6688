"""Small gradient-boosted trees and isotonic regression, in numpy.

They are fitted on samples of documented size; predicting is vectorised and
may run over any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: node k has children 2k + 1 (at most the cut) and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return self.value[node - (2**self.depth - 1)]


@dataclass
class Boosted:
    """Log-odds: a base and the sum of trees."""

    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Logistic-loss boosting with second-order gains over binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))), [])
    raw = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        tree = Tree(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth), depth)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            local = node - first
            for j in range(width):
                size = len(cuts[j]) + 1
                key = local * size + binned[:, j]
                g = np.bincount(key, gradient, many * size).reshape(many, size).cumsum(axis=1)
                h = np.bincount(key, weight, many * size).reshape(many, size).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], g_all - g[:, :-1], h_all - h[:, :-1]
                if not gl.shape[1]:
                    continue
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g_all**2 / (h_all + ridge)
                gain[(hl < least) | (hr < least)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = top > best
                best[better] = top[better]
                tree.feature[first : first + many][better] = j
                tree.cut[first : first + many][better] = cuts[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), tree.feature[node]] > tree.cut[node])
        leaf = node - (2**depth - 1)
        tree.value[:] = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + ridge)
        raw += tree.value[leaf]
        model.trees.append(tree)
    return model


@dataclass
class Isotonic:
    """A rising step-wise linear map."""

    at: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def fit_isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators: the nearest rising map by weighted squares."""
    order = np.argsort(x, kind="stable")
    keys, start = np.unique(x[order], return_index=True)
    total = np.add.reduceat(weight[order], start)
    mean = np.add.reduceat((weight * y)[order], start) / total
    blocks: list[list[float]] = []  # mean, weight, first key, last key
    for k, m, w in zip(keys.tolist(), mean.tolist(), total.tolist()):
        blocks.append([m, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return Isotonic(at, np.array([b[0] for b in blocks for _ in (0, 1)]))
