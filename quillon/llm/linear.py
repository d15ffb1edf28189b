"""Logistic regression on the driver, for bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge penalty. One class only gives its smoothed rate."""
    n, k = x.shape
    w = np.zeros(k + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < n:
        return w
    x1 = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag(np.r_[np.full(k, ridge), 1e-6])
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + penalty, x1.T @ (p - y) + penalty @ w)
        largest = np.abs(step).max()
        w -= step * min(1.0, 4 / max(largest, 1e-12))
        if largest < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
