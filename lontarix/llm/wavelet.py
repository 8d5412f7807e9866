"""Range reporting in the plane by a wavelet matrix over a permutation."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Points (i, seq[i]); ``seq`` is a permutation of 0 .. n - 1. A level holds one bit of every value, most significant first,
    as counts of zeros before each place; values with a zero bit go to the front of the next level."""

    def __init__(self, seq: np.ndarray) -> None:
        self.bits = max(1, int(len(seq) - 1).bit_length()) if len(seq) else 1
        self.zeros = []
        for shift in range(self.bits - 1, -1, -1):
            zero = (seq >> shift) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            seq = np.concatenate([seq[zero], seq[~zero]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all points of query k with a[k] <= i < b[k] and c[k] <= value < d[k]; all queries descend together."""
        q = np.flatnonzero((a < b) & (c < d))
        a, b, base = a[q], b[q], np.zeros(len(q), np.int64)
        for zeros, shift in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            za, zb, wide = zeros[a], zeros[b], 1 << shift
            a, b = np.concatenate([za, zeros[-1] + a - za]), np.concatenate([zb, zeros[-1] + b - zb])
            q, base = np.concatenate([q, q]), np.concatenate([base, base + wide])
            live = np.flatnonzero((a < b) & (base < d[q]) & (base + wide > c[q]))
            a, b, q, base = a[live], b[live], q[live], base[live]
        return q, base
