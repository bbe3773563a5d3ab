"""A small ridge logistic regression on driver-side arrays of bounded size."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept first) in units of ``x``; damped Newton steps, standardised inside.

    Without rows the result is all zeros; with one class only it is that class's smoothed log odds."""
    width = x.shape[1]
    if not len(y):
        return np.zeros(width + 1)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return np.append(prior, np.zeros(width))
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    z = np.column_stack([np.ones(len(y)), (x - mean) / sd])
    penalty = np.full(width + 1, ridge)
    penalty[0] = 0.0

    def loss(b: np.ndarray) -> float:
        s = z @ b
        return float(np.logaddexp(0, s).sum() - y @ s + 0.5 * (penalty * b * b).sum())

    b = np.append(prior, np.zeros(width))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        gradient = z.T @ (y - p) - penalty * b
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        move, now = np.linalg.solve(hessian, gradient), loss(b)
        while loss(b + move) > now and np.abs(move).max() > 1e-9:
            move /= 2
        b = b + move
        if np.abs(move).max() < 1e-7:
            break
    slope = b[1:] / sd
    return np.append(b[0] - slope @ mean, slope)


def probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -35, 35)))
