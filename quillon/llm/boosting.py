"""Gradient-boosted regression trees and isotonic calibration, in numpy.

Trained on the driver on a bounded sample; applied to batches anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """A tree of full depth: node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def apply(self, binned: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        for _ in range(depth):
            node = 2 * node + 1 + (binned[rows, self.feature[node]] > self.bin[node])
        return self.value[node]


@dataclass
class Boosted:
    """Squared-error boosting over binned features."""

    trees: int = 80
    depth: int = 4
    rate: float = 0.1
    least: int = 20
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    grown: list[Tree] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.int64)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        self.base = float(y.mean()) if len(y) else 0.0
        rest = y - self.base
        self.grown = []
        for _ in range(self.trees):
            tree = self._grow(binned, rest)
            self.grown.append(tree)
            rest = rest - tree.apply(binned, self.depth)
        return self

    def _grow(self, binned: np.ndarray, rest: np.ndarray) -> Tree:
        n, width = binned.shape
        inner, total = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        feature = np.zeros(inner, dtype=np.int64)
        cut = np.full(inner, BINS, dtype=np.int64)  # beyond every bin: all rows go left
        value = np.zeros(total)
        node = np.zeros(n, dtype=np.int64)
        for level in range(self.depth):
            first, here = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(here)
            for j in range(width):
                slot = at * BINS + binned[:, j]
                count = np.bincount(slot, minlength=here * BINS).reshape(here, BINS).cumsum(axis=1)
                total_rest = np.bincount(slot, weights=rest, minlength=here * BINS).reshape(here, BINS).cumsum(axis=1)
                n_all, r_all = count[:, -1:], total_rest[:, -1:]
                n_right, r_right = n_all - count, r_all - total_rest
                fine = (count >= self.least) & (n_right >= self.least)
                gain = np.where(fine, total_rest**2 / np.maximum(count, 1) + r_right**2 / np.maximum(n_right, 1) - r_all**2 / np.maximum(n_all, 1), 0.0)
                top = gain.argmax(axis=1)
                won = gain[np.arange(here), top] > best + 1e-12
                best = np.where(won, gain[np.arange(here), top], best)
                feature[first : first + here] = np.where(won, j, feature[first : first + here])
                cut[first : first + here] = np.where(won, top, cut[first : first + here])
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaves = np.bincount(node, minlength=total)
        sums = np.bincount(node, weights=rest, minlength=total)
        value = self.rate * sums / np.maximum(leaves, 1)
        return Tree(np.concatenate([feature, np.zeros(total - inner, dtype=np.int64)]), np.concatenate([cut, np.full(total - inner, BINS)]), value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        out = np.full(len(x), self.base)
        for tree in self.grown:
            out += tree.apply(binned, self.depth)
        return out


def isotonic(x: np.ndarray, y: np.ndarray, knots: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to y, as knots for interpolation."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    means: list[list[float]] = []  # mean of y, weight, sum of x
    for a, b in zip(xs, ys):
        means.append([float(b), 1.0, float(a)])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            m, w, s = means.pop()
            means[-1] = [(means[-1][0] * means[-1][1] + m * w) / (means[-1][1] + w), means[-1][1] + w, means[-1][2] + s]
    at = np.array([s / w for _, w, s in means])
    value = np.array([m for m, _, _ in means])
    if len(at) > knots:
        take = np.unique(np.linspace(0, len(at) - 1, knots).astype(int))
        at, value = at[take], value[take]
    return at, value
