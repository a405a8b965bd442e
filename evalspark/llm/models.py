"""Small dense models, fitted on the driver over bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept, not penalised) of an L2 logistic regression by damped Newton steps.

    With a single class in y the result is a constant close to that class's smoothed share.
    """
    design = np.column_stack((x, np.ones(len(x))))
    weights = np.zeros(design.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    weights[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return weights
    penalty = np.full(design.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = logistic(design @ weights)
        step = np.linalg.solve(
            (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty),
            design.T @ (p - y) + penalty * weights,
        )
        weights -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss (y in -1, 1), by Newton steps on the active rows."""
    design = np.column_stack((x, np.ones(len(x), dtype=x.dtype)))
    beta = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], l2)
    penalty[-1] = 1e-6
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    active = np.ones(len(x), dtype=bool)
    for _ in range(rounds):
        rows, w = design[active], weight[active]
        beta = np.linalg.solve((rows * w[:, None]).T @ rows + np.diag(penalty), rows.T @ (w * y[active]))
        now = y * (design @ beta) < 1
        if (now != active).mean() < 1e-3:
            break
        active = now
    return beta[:-1], float(beta[-1])
