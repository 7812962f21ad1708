"""Boosting on binned features in numpy: gradient-boosted trees, and additive tables with pairwise interactions.

Both learn from a bounded sample on the driver, with logistic loss; what is shipped to executors has a size set by
parameters alone (edges, trees, tables).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature, up to bins - 1 cuts at quantiles of its distinct values."""
    out = []
    for col in x.T:
        values = np.unique(col)
        mids = (values[1:] + values[:-1]) / 2
        out.append(mids if len(mids) < bins else np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, col, side="right") for e, col in zip(edges, x.T, strict=True)]) if len(edges) else np.zeros((len(x), 0), dtype=np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g, h, total_g, total_h, ridge):
    return g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g * total_g / (total_h + ridge)


@dataclass
class BoostedTrees:
    """Trees as nested tuples (feature, bin, left, right) or a leaf's value."""

    edges: list[np.ndarray]
    base: float
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = binned(x, self.edges), np.full(len(x), self.base)
        for tree in self.trees:
            z += _leaf_values(tree, b)
        return sigmoid(z)


def _leaf_values(tree, b: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(b), tree)
    feature, cut, left, right = tree
    low = b[:, feature] <= cut
    out = np.empty(len(b))
    out[low], out[~low] = _leaf_values(left, b[low]), _leaf_values(right, b[~low])
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> BoostedTrees:
    edges = bin_edges(x, bins) if len(x) else []
    prior = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    model = BoostedTrees(edges, float(np.log(prior / (1 - prior))))
    b, z = binned(x, edges), np.full(len(x), model.base)

    def grow(rows, g, h, level):
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), None
        if level < depth and len(rows) >= 2 * least:
            for f in range(b.shape[1]):
                n = np.cumsum(np.bincount(b[rows, f], minlength=len(edges[f]) + 1))[:-1]
                gs = np.cumsum(np.bincount(b[rows, f], g[rows], len(edges[f]) + 1))[:-1]
                hs = np.cumsum(np.bincount(b[rows, f], h[rows], len(edges[f]) + 1))[:-1]
                gain = np.where((n >= least) & (len(rows) - n >= least), _gain(gs, hs, total_g, total_h, ridge), -1)
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), f, int(gain.argmax()))
        if best is None:
            return float(rate * total_g / (total_h + ridge))
        low = b[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], g, h, level + 1), grow(rows[~low], g, h, level + 1)

    if len(x) and 0 < y.mean() < 1:
        for _ in range(rounds):
            p = sigmoid(z)
            tree = grow(np.arange(len(x)), y - p, p * (1 - p), 0)
            model.trees.append(tree)
            z += _leaf_values(tree, b)
    return model


@dataclass
class AdditiveModel:
    """A lookup table for each feature and for each chosen pair of features; a score is a sum of table entries."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        b = binned(x, self.edges)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        if self.pairs:
            c = binned(x, self.pair_edges)
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                z += table[c[:, i], c[:, j]]
        return sigmoid(z)


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of a few leaves over one feature's bins, as the value of each bin."""
    cuts, cg, ch = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                gain = _gain(cg[lo + 1 : hi] - cg[lo], ch[lo + 1 : hi] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
                if gain.max() > best[0]:
                    best = (gain.max(), lo + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four leaves: its gain, and the value of each cell."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))

    def corners(c):
        a = c[1:-1, 1:-1]
        top, side, total = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, top - a, side - a, total - top - side + a

    parts = list(zip(corners(cg), corners(ch), strict=True))
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(a * a / (b + ridge) for a, b in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, leaves: int = 3, bins: int = 32, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 60, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting: each round visits the features in turn with a shallow tree on one feature; then, with these tables
    fixed, the pairs of features with the largest gain on the residuals get tables of their own in the same way."""
    edges, coarse = (bin_edges(x, bins), bin_edges(x, pair_bins)) if len(x) else ([], [])
    prior = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    model = AdditiveModel(edges, coarse, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(x) or y.mean() in (0, 1):
        return model
    b, c, z = binned(x, edges), binned(x, coarse), np.full(len(x), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = sigmoid(z)
            step = rate * _shallow(np.bincount(b[:, f], y - p, len(table)), np.bincount(b[:, f], p * (1 - p), len(table)), leaves, ridge)
            table += step
            z += step[b[:, f]]

    def grid(i, j, p):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = c[:, i] * shape[1] + c[:, j]
        return cell, shape, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = sigmoid(z)
    gains = {(i, j): _quadrants(*grid(i, j, p)[2:], ridge)[0] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            cell, _, g, h = grid(i, j, sigmoid(z))
            step = rate * _quadrants(g, h, ridge)[1]
            table += step
            z += step.ravel()[cell]
    return model
