"""Small dense systems in plain NumPy.

The driver holds a JVM beside Python; threaded LAPACK calls were seen to hang
there. What the driver solves is at most 128 x 128, so that elementwise sums and
row operations do.
"""

from __future__ import annotations

import numpy as np


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of a matrix and a vector."""
    return (a * b).sum(axis=1)


def gram(a: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``a.T @ diag(weight) @ a``."""
    return np.stack([(a * (weight * c)[:, None]).sum(axis=0) for c in a.T])


def inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivots; ValueError if the matrix is singular."""
    n = len(a)
    work = np.concatenate((a.astype(float), np.eye(n)), axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if abs(work[p, k]) < 1e-300:
            raise ValueError("singular matrix")
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= np.multiply.outer(factor, work[k])
    return work[:, n:]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with ``a @ x = b``."""
    return product(inverse(a), b)
