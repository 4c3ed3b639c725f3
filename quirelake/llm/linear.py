"""Small linear classifiers over hashed features, trained on the driver from bounded samples."""

from __future__ import annotations

import zlib

import numpy as np

BITS = 16


def slots(features: list[str], bits: int = BITS) -> list[int]:
    mask = (1 << bits) - 1
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & mask for f in features]


class Logistic:
    """Maximum entropy for two classes over sparse 0/1 features (several rows of slots, one row a case)."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.weights = np.zeros((1 << bits) + 1, np.float64)

    def fit(self, rows: list[list[int]], labels: np.ndarray, importance: np.ndarray | None = None, rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Logistic:
        """Full-batch Adagrad; deterministic. No rows: the classifier stays at even odds."""
        if not rows:
            return self
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((s for r in rows for s in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        y = np.asarray(labels, np.float64)
        w = np.ones(len(rows)) if importance is None else np.asarray(importance, np.float64)
        w = w / w.sum()
        squares = np.full(len(self.weights), 1e-10)
        bias = len(self.weights) - 1
        for _ in range(rounds):
            z = np.bincount(owner, self.weights[flat], len(rows)) + self.weights[bias]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w
            grad = np.bincount(flat, error[owner], len(self.weights)) + decay * self.weights
            grad[bias] = error.sum()
            squares += grad * grad
            self.weights -= rate * grad / np.sqrt(squares)
        return self

    def score(self, row: list[int]) -> float:
        w = self.weights
        return float(sum(w[s] for s in row) + w[-1])
