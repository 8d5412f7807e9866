"""Vectorised words, word hashes and shingles over UTF-8 buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes have 64 bits and depend on the bytes alone, so they agree
between executors and runs.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for n texts the n + 1 positions among the words where a text begins."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = off[off < n]
    begin[edge] = solid[edge]
    edge = off[off > 0] - 1
    end[edge] = solid[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    size = ends - starts
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(wide) - 7,), "<u8", wide.data, strides=(1,))
    h = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) + _A * (size.astype(np.uint64) + np.uint64(1)))
    at, more = 8, np.flatnonzero(size > 8)
    while len(more):
        left = np.minimum(size[more] - at, 8)
        h[more] = mix(h[more] * _A + (eight[starts[more] + at] & _KEEP[left]))
        at += 8
        more = more[size[more] > at]
    return h


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows, and the n + 1 positions where a text's windows begin."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    x = h[at]
    for i in range(1, k):
        x = mix(x * _A + h[at + i])
    return x, begin


def whole(h: np.ndarray) -> np.uint64:
    """The hash of a whole sequence shorter than a window; unlike any window's by its length."""
    x = mix(np.array([len(h)], np.uint64) * _C + _B)
    for v in h:
        x = mix(x * _A + v)
    return x[0]
