"""Logistic regression on a bounded sample, by Newton steps."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of (x, 1) for the probability that y is 1. The last is the intercept, which is not shrunk."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = chance(z @ beta)
        gradient = z.T @ (w * (y - p)) - penalty * beta
        curve = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def chance(score: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probability that y is 1."""
    return chance(x @ beta[:-1] + beta[-1])
