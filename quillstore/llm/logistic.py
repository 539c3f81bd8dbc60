"""Small logistic regressions, fitted on the driver on bounded labelled tables."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, l1: float = 0.0, l2: float = 1e-4, steps: int = 600, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) by proximal gradient descent with momentum; l1 makes the weights sparse.  Deterministic."""
    n, d = x.shape
    w, b = np.zeros((d, classes), x.dtype), np.zeros(classes, x.dtype)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    target = np.eye(classes, dtype=x.dtype)[y]
    step = rate / max(1.0, float((x**2).sum(1).mean()) / 4)
    for _ in range(steps):
        g = (softmax(x @ w + b) - target) / n
        vw = 0.9 * vw - step * (x.T @ g + l2 * w)
        vb = 0.9 * vb - step * g.sum(0)
        w, b = w + vw, b + vb
        if l1:
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
    return w, b


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The factor on scores under which held-out rows are most likely."""
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
