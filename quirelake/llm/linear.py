"""Linear hinge-loss models over sparse rows, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, cost: float | np.ndarray = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + sum of cost * hinge; rows hold (indices, values).

    Each step solves the one-variable dual problem of one row within its box [0, cost].
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    box = np.broadcast_to(np.asarray(cost, float), len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slack = sign[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slack / norms[i], 0.0), box[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * sign[i] * v
                w[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def fit_sigmoid(margin: np.ndarray, positive: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the smoothed log loss; a is at least 1e-3."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    goal = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        gap, curve = p - goal, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([gap @ margin, gap.sum()])
        hess = np.array([[curve @ margin**2 + 1e-6, curve @ margin], [curve @ margin, curve.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b
