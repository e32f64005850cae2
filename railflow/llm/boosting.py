"""Small gradient-boosted trees on binned features, for a bounded training sample."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic loss, Newton leaves, depth-wise trees on quantile bins; deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []  # per node: feature (-1: leaf), threshold, value
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, p - y, p * (1 - p) + 1e-9)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0.0, 0.0)] * size
        rows = {0: np.arange(len(g))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            gs, hs = g[own].sum(), h[own].sum()
            best = (1e-6, -1, 0)
            if node < size // 2 and len(own) >= 2 * self.least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[own, j], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (len(own) - nl < self.least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                tree[node] = (-1, 0.0, float(-self.rate * gs / (hs + 1)))
                continue
            _, j, k = best
            tree[node] = (j, float(cuts[j][k]), 0.0)
            left = binned[own, j] <= k
            rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return tree

    def _walk(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for tree in self.trees:
            margin += self._walk(tree, x)
        return 1 / (1 + np.exp(-margin))
