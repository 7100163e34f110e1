"""Sparse linear models: follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    top = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return top / top.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    size: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.1,
    l2: float = 0.1,
    seed: int = 7,
) -> np.ndarray:
    """Multinomial weights ``(size, classes)`` by per-coordinate FTRL-proximal.

    ``rows`` are ``(indices, values)``; ``targets`` holds one probability per class, so
    soft labels are fine. Coordinates whose accumulated gradient stays within ``l1`` are
    exactly zero. The row order is a fixed permutation, so a fit can be repeated.
    """
    classes = targets.shape[1]
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * l1 - zi
        return np.where(np.abs(zi) > l1, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(seed).permutation(len(rows))
    for _ in range(epochs):
        for r in order:
            at, x = rows[r]
            w = weights(at)
            gradient = x[:, None] * (softmax(x @ w) - targets[r])[None, :]
            squares = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    return weights(np.arange(size))


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the least log loss, by golden section."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * log_t * log_t

    low, high, ratio = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
