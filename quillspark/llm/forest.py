"""A small random forest of binary classification trees, fitted and applied in numpy."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, MIN_LEAF = 31, 9, 2


class Forest:
    """Trees as flat arrays (feature, threshold, left child, share of label 1); feature -1 is a leaf."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.trees = trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees' leaves, for each row."""
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                right = x[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(go, left[at] + right, at)
            out += share[at]
        return out / max(1, len(self.trees))


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold of least Gini impurity, or None."""
    best, found = np.inf, None
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= MIN_LEAF) & (cut <= n - MIN_LEAF)]
        if not len(cut):
            continue
        a = ones[cut - 1] / cut
        b = (ones[-1] - ones[cut - 1]) / (n - cut)
        impurity = cut * a * (1 - a) + (n - cut) * b * (1 - b)
        k = int(impurity.argmin())
        if impurity[k] < best:
            best, found = impurity[k], (int(f), float((v[cut[k]] + v[cut[k] - 1]) / 2))
    return found


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Forest:
    """Bootstrap samples, and a random third of the features at each node."""
    rng = np.random.default_rng(seed)
    wide = max(2, x.shape[1] // 3)
    trees = []
    for _ in range(TREES):
        pick = rng.integers(0, len(y), len(y))
        feature, threshold, left, share = [-1], [0.0], [0], [float(y[pick].mean())]
        todo = [(0, pick, 0)]
        while todo:
            node, rows, depth = todo.pop()
            if depth >= DEPTH or share[node] in (0.0, 1.0):
                continue
            cut = _split(x[rows], y[rows], rng.permutation(x.shape[1])[:wide])
            if cut is None:
                continue
            feature[node], threshold[node], left[node] = cut[0], cut[1], len(feature)
            over = x[rows, cut[0]] > cut[1]
            for part in (rows[~over], rows[over]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1)
                threshold.append(0.0)
                left.append(0)
                share.append(float(y[part].mean()))
        trees.append((np.array(feature), np.array(threshold), np.array(left), np.array(share)))
    return Forest(trees)
