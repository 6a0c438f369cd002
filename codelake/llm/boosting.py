"""Small boosted models in numpy: a generalised additive model with pairwise interactions, and trees.

Both work on features cut into at most 64 quantile bins and take the logistic loss.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BINS = 64


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Cuts between bins, by quantiles of each column."""
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(c, q)) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], 1).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float, lam: float) -> tuple[float, int]:
    """(gain, bins to the left) of the best cut of ordered bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam), 0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


class PairwiseGam:
    """score = intercept + sum of f(bin of feature) + sum of f(bins of two features).

    Cyclic boosting: each round fits a shallow tree to each feature's gradients in turn and adds it to the
    feature's lookup table. The pairs that explain most of what the single features leave get tables too.
    """

    def __init__(self, rounds: int = 150, rate: float = 0.1, pairs: int = 8, lam: float = 1.0, least: float = 2.0):
        self.rounds, self.rate, self.n_pairs, self.lam, self.least = rounds, rate, pairs, lam, least

    def _shallow(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of up to four leaves over ordered bins, as a table of steps."""
        parts = [(0, len(g))]
        for _ in range(3):
            best = max(((*_best_cut(g[a:b], h[a:b], self.least, self.lam), a, b) for a, b in parts), default=(0, 0, 0, 0))
            if best[0] <= 1e-9:
                break
            _, k, a, b = best
            parts.remove((a, b))
            parts += [(a, a + k), (a + k, b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + self.lam)
        return out

    def _quad(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """A tree of up to four leaves over two features: the first is cut, then each side by the second."""
        best, where = 0.0, None
        rows_g, rows_h = g.sum(1), h.sum(1)
        for k in range(1, len(g)):
            total, cuts = 0.0, []
            for side in (slice(0, k), slice(k, None)):
                gain, c = _best_cut(g[side].sum(0), h[side].sum(0), self.least, self.lam)
                gs, hs = rows_g[side].sum(), rows_h[side].sum()
                total += gain + gs**2 / (hs + self.lam)
                cuts.append(c if gain > 0 else 0)
            total -= g.sum() ** 2 / (h.sum() + self.lam)
            if total > best:
                best, where = total, (k, cuts)
        out = np.zeros(g.shape)
        if where:
            k, cuts = where
            for side, c in zip((slice(0, k), slice(k, None)), cuts):
                for part in (slice(0, c), slice(c, None)):
                    if h[side, part].size:
                        out[side, part] = self.rate * g[side, part].sum() / (h[side, part].sum() + self.lam)
        return best, out

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        self.edges = edges_of(x)
        b = binned(x, self.edges)
        n, m = b.shape
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        self.intercept = float(np.log(mean / (1 - mean)))
        self.tables = [np.zeros(BINS) for _ in range(m)]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        z = np.full(n, self.intercept)
        for _ in range(self.rounds if n else 0):
            for j in range(m):
                p = sigmoid(z)
                step = self._shallow(np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS))
                self.tables[j] += step
                z += step[b[:, j]]
        coarse = b // 8
        cell = lambda i, j: coarse[:, i] * 8 + coarse[:, j]
        grid = lambda i, j, v: np.bincount(cell(i, j), v, 64).reshape(8, 8)
        if n:
            p = sigmoid(z)
            ranked = sorted(((self._quad(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i, j in combinations(range(m), 2)), reverse=True)
            self.pairs = [(i, j) for gain, i, j in ranked[: self.n_pairs] if gain > 0]
            self.grids = [np.zeros((8, 8)) for _ in self.pairs]
            for _ in range(self.rounds // 3):
                for k, (i, j) in enumerate(self.pairs):
                    p = sigmoid(z)
                    _, step = self._quad(grid(i, j, y - p), grid(i, j, p * (1 - p)))
                    self.grids[k] += step
                    z += step.ravel()[cell(i, j)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        z = np.full(len(b), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            z += grid[b[:, i] // 8, b[:, j] // 8]
        return sigmoid(z)


class Trees:
    """Gradient-boosted trees of a given depth, grown level by level on histograms."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, lam: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.lam, self.least = rounds, depth, rate, lam, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = edges_of(x)
        b = binned(x, self.edges)
        n, m = b.shape
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.intercept = float(np.log(mean / (1 - mean)))
        z = np.full(n, self.intercept)
        self.trees = []
        for _ in range(self.rounds):
            p = sigmoid(z)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature = np.full(2 ** (self.depth + 1), -1)
            cut = np.zeros(2 ** (self.depth + 1), np.int64)
            leaf = np.zeros(2 ** (self.depth + 1))
            node[:] = 1
            for _level in range(self.depth):
                for k in np.unique(node):
                    own = node == k
                    best = (1e-6, 0, 0)
                    for j in range(m):
                        gain, c = _best_cut(np.bincount(b[own, j], g[own], BINS), np.bincount(b[own, j], h[own], BINS), self.least, self.lam)
                        if gain > best[0]:
                            best = (gain, j, c)
                    if best[2]:
                        feature[k], cut[k] = best[1], best[2]
                for k in np.unique(node):
                    if feature[k] >= 0 and k < 2**self.depth:
                        own = node == k
                        node[own] = 2 * k + (b[own, feature[k]] >= cut[k])
            for k in np.unique(node):
                own = node == k
                leaf[k] = self.rate * g[own].sum() / (h[own].sum() + self.lam)
            self.trees.append((feature, cut, leaf))
            z += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        z = np.full(len(b), self.intercept)
        rows = np.arange(len(b))
        for feature, cut, leaf in self.trees:
            node = np.ones(len(b), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                node = np.where(go, 2 * node + (b[rows, np.maximum(f, 0)] >= cut[node]), node)
            z += leaf[node]
        return z


class Calibrated:
    """Platt scaling of raw scores, fitted on rows that the model has not seen."""

    def fit(self, z: np.ndarray, y: np.ndarray, steps: int = 200) -> Calibrated:
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = sigmoid(a * z + b)
            g, w = p - y, p * (1 - p) + 1e-6
            grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.a, self.b = a, b
        return self

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * z + self.b)
