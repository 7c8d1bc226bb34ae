"""Hilbert curve keys of integer points, vectorised over rows."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of points (n x d unsigned cells below 2**bits); d * bits <= 63.

    Gray-code transposition: undo the rotations from the top bit down, then interleave the bits.
    """
    n, d = points.shape
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key
