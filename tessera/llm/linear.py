"""Logistic regression on the driver, over a bounded matrix."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(blocks: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float = 1e-3, rounds: int = 200, balanced: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic model of scale * x by accelerated full-batch descent.

    blocks: row blocks of x, bool or float.  With no rows of one of the classes the model is the constant base rate.
    """
    n, d = len(y), len(scale)
    w, b = np.zeros(d), 0.0
    pos = float(y.sum())
    if n == 0 or pos in (0.0, float(n)):
        rate = (pos + 0.5) / (n + 1.0)
        return w, float(np.log(rate / (1 - rate)))
    weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos)) if balanced else np.ones(n)
    weight = weight / weight.sum()
    cut = np.cumsum([0, *(len(x) for x in blocks)])
    norm = sum(float((weight[a : a + len(x)] * ((np.asarray(x, dtype=np.float32) * scale.astype(np.float32)) ** 2).sum(axis=1)).sum()) for x, a in zip(blocks, cut))
    step = 1.0 / (0.25 * (norm + 1.0) + l2)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        gw, gb = np.zeros(d), 0.0
        for x, a in zip(blocks, cut):
            f = np.asarray(x, dtype=np.float32)
            r = (sigmoid(f @ (vw * scale).astype(np.float32) + vb) - y[a : a + len(x)]) * weight[a : a + len(x)]
            gw += (f.T @ r.astype(np.float32)) * scale
            gb += float(r.sum())
        nw, nb = vw - step * (gw + l2 * vw), vb - step * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b
