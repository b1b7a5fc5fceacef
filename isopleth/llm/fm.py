"""Factorisation machine over hashed sparse rows.

``logit(x) = b + sum_j w_j x_j + 1/2 sum_f [ (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2 ]``: the sum-of-squares identity
gives all pairwise interactions in time linear in the entries of a row. Fitting is AdaGrad on mini-batches of a bounded
sample; scoring is a few vectorised passes over the entries of a slab of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # (buckets,)
    factors: np.ndarray  # (buckets, rank)

    def logits(self, index: np.ndarray, value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """One logit for each row of a sparse matrix; ptr has the first entry of every row, and the end."""
        return _forward(self.bias, self.linear, self.factors, index, value, ptr)[0]

    def scores(self, index: np.ndarray, value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, value, ptr), -60, 60)))


def row_sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of x over each row's entries; 0 for rows without entries."""
    out = np.zeros((len(ptr) - 1, *x.shape[1:]), np.float64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, ptr[full], axis=0, dtype=np.float64)
    return out


def _forward(bias, linear, factors, index, value, ptr):
    vx = factors[index] * value[:, None]
    sums = row_sums(vx, ptr)
    squares = row_sums(vx * vx, ptr)
    return bias + row_sums(linear[index] * value, ptr) + 0.5 * (sums**2 - squares).sum(1), sums


def fit(index: np.ndarray, value: np.ndarray, ptr: np.ndarray, label: np.ndarray, buckets: int, rank: int = 4, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, factor_decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit on rows of a sparse matrix. A single class, or no row, gives a constant score."""
    rng = np.random.default_rng(seed)
    linear = np.zeros(buckets)
    factors = rng.normal(0, 0.02, (buckets, rank))
    n = len(label)
    rate_of_ones = (label.sum() + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if n == 0 or label.min() == label.max():
        return Machine(bias, linear, np.zeros((buckets, rank)))
    g_linear, g_factors, g_bias = np.full(buckets, 1e-6), np.full((buckets, rank), 1e-6), 1e-6
    size = 32
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, size):
            rows = order[at : at + size]
            lens = ptr[rows + 1] - ptr[rows]
            own = np.concatenate([[0], np.cumsum(lens)])
            entries = np.repeat(ptr[rows] - own[:-1], lens) + np.arange(own[-1])
            idx, x, row = index[entries], value[entries], np.repeat(np.arange(len(rows)), lens)
            logit, sums = _forward(bias, linear, factors, idx, x, own)
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - label[rows]) / size
            used, inverse = np.unique(idx, return_inverse=True)
            ex = error[row] * x
            grad = np.bincount(inverse, ex, len(used)) + decay * linear[used]
            g_linear[used] += grad**2
            linear[used] -= rate * grad / np.sqrt(g_linear[used])
            each = ex[:, None] * (sums[row] - factors[idx] * x[:, None])
            grad2 = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(rank)], 1) + factor_decay * factors[used]
            g_factors[used] += grad2**2
            factors[used] -= 0.3 * rate * grad2 / np.sqrt(g_factors[used])
            g_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(g_bias)
    return Machine(float(bias), linear, factors)
