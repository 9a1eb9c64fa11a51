"""Logistic loss minimised by L-BFGS, for the small models of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, np.float64)))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS (Nocedal 1980) with step halving, for smooth convex losses."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append(a := (s @ d) / (s @ y))
            d -= a * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        slope, t = -(g @ d), 1.0 if past else 1.0 / max(1.0, float(np.abs(g).sum()))
        while True:
            new, gnew = loss(x - t * d)
            if new <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = -t * d, gnew - g
        x, gain = x + s, f - new
        f, g = new, gnew
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)] if len(past) >= memory else [*past, (s, y)]
        if gain <= 1e-8 * max(1.0, abs(f)):
            break
    return x


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, n: int, scale: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sets of feature ids, each feature having the value `scale[id]`."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) and lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    value = scale[flat]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[flat] * value, len(rows)) + w[-1]
        sign = np.where(y == 1, 1.0, -1.0)
        out = np.logaddexp(0, -sign * z).mean() + l2 * (w[:-1] @ w[:-1])
        dz = -sign * sigmoid(-sign * z) / len(rows)
        grad = np.append(np.bincount(flat, dz[row] * value, n) + 2 * l2 * w[:-1], dz.sum())
        return out, grad

    w = minimise(loss, np.zeros(n + 1))
    return w[:-1] * scale, float(w[-1])
