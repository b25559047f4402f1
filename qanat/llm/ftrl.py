"""FTRL-proximal learners with elastic-net penalties on sparse rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Ftrl:
    """Weights of ``outputs`` logits over ``dims`` features, one row at a time.

    Per coordinate: learning rate alpha / (beta + sqrt(sum of squared
    gradients)); L1 keeps a weight at 0 until its evidence passes ``l1``; L2
    shrinks the rest.  The bias is a feature without penalty.
    """

    def __init__(self, dims: int, outputs: int = 1, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims + 1, outputs)), np.zeros((dims + 1, outputs))
        self.dims, self.outputs = dims, outputs

    def _weights(self, z: np.ndarray, n: np.ndarray, free_last: bool) -> np.ndarray:
        l1 = np.full((len(z), 1), self.l1)
        if free_last:
            l1[-1] = 0.0
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= l1] = 0.0
        return w

    def step(self, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
        """One row: features ``idx`` (distinct) with values ``val``; y has a target per output."""
        at = np.append(idx, self.dims)
        x = np.append(val, 1.0)[:, None]
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n, True)
        s = (w * x).sum(0)
        if self.outputs == 1:
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
        else:
            e = np.exp(s - s.max())
            p = e / e.sum()
        g = (p - y) * x
        n2 = n + g * g
        self.z[at] = z + g - (np.sqrt(n2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n2

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, seed: int = 1) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.step(*rows[i])
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(dims x outputs weights, biases)."""
        w = self._weights(self.z, self.n, True)
        return w[:-1], w[-1]
