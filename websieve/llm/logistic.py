"""Logistic regression on bounded samples, by Newton steps in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias for unscaled x. Columns are standardised inside; ridge bounds weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        largest = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(largest, 1e-12))
        if largest < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean)
