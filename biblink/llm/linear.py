"""Logistic regression in numpy over sparse binary features, for the classifiers here."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse binary rows: feature numbers of all rows, one after another."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.feature = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n)

    def t_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, g[self.row], size)


def fit(rows: Rows, y: np.ndarray, size: int, swapped: Rows | None = None, originals: np.ndarray | None = None, fairness: float = 0.0, l2: float = 1e-4, steps: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole batch.

    With ``swapped`` rows, counterparts of the rows numbered ``originals``, the
    squared change of the score between counterparts is penalised by ``fairness``.
    """
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.full(rows.n, 1 / max(1, rows.n)) if weight is None else weight / weight.sum()
    for t in range(1, steps + 1):
        score = rows.dot(w) + b
        g = (sigmoid(score) - y) * weight
        grad = np.r_[rows.t_dot(g, size) + l2 * w, g.sum()]
        if swapped is not None and swapped.n:
            change = swapped.dot(w) - (score - b)[originals]
            push = 2 * fairness * change / swapped.n
            back = np.zeros(rows.n)
            np.add.at(back, originals, push)
            grad[:-1] += swapped.t_dot(push, size) - rows.t_dot(back, size)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)
