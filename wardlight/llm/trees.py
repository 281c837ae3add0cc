"""Gradient-boosted trees on binned measures, for two classes. Small enough to fit on the driver."""

import numpy as np

BINS = 64


class Boosted:
    """Log-odds as a sum of trees of fixed depth; a tree is arrays over a full binary tree."""

    def __init__(self, edges: list, trees: list, start: float, depth: int):
        self.edges, self.trees, self.start, self.depth = edges, trees, start, depth

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, total, rows = self.bins(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += value[node]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; each split has the best gain over all measures and bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    rate0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(edges, [], float(np.log(rate0 / (1 - rate0))), depth)
    b, total = model.bins(x), np.full(len(x), model.start)
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(2 * inner + 1, int), np.full(2 * inner + 1, BINS), np.zeros(2 * inner + 1)
        node = np.zeros(len(x), int)
        for level in range(depth):
            first = 2 ** level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    feature[k], cut[k] = _split(b[rows], g[rows], h[rows], ridge, least)
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        sums, weights = np.bincount(node, g, 2 * inner + 1), np.bincount(node, h, 2 * inner + 1)
        value[inner:] = (rate * sums / (weights + ridge))[inner:]
        model.trees.append((feature, cut, value))
        total += value[node]
    return model


def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[int, int]:
    best, found = 1e-6, (0, BINS)
    gain0 = g.sum() ** 2 / (h.sum() + ridge)
    for j in range(b.shape[1]):
        gl, hl = np.cumsum(np.bincount(b[:, j], g, BINS))[:-1], np.cumsum(np.bincount(b[:, j], h, BINS))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - gain0, 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = float(gain[k]), (j, k)
    return found
