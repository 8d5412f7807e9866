"""A cuckoo filter over 64-bit keys: four 16-bit fingerprints a bucket, insertion, deletion, vectorised membership."""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS = 4
_LOW = np.uint64(0xFFFF)
_48 = np.uint64(48)


class CuckooFilter:
    """Membership without false negatives for inserted keys; about 1 in 8,000 absent keys answers yes.

    ``table`` has a power of two of rows. A key that can't be placed after 500 moves doubles the table, so ``keys`` (all
    keys present) are needed again then: ``build`` does it.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        rows = 1
        while rows * SLOTS * 0.84 < len(keys) + 1:
            rows *= 2
        while True:
            made = cls(np.zeros((rows, SLOTS), np.uint16))
            if made.insert_all(np.asarray(keys, np.uint64)):
                return made
            rows *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.uint64(len(self.table) - 1)
        mark = (keys >> _48) & _LOW
        mark = np.where(mark == 0, np.uint64(1), mark)
        one = mix(keys) & rows
        return mark.astype(np.uint16), one.astype(np.int64), ((one ^ mix(mark)) & rows).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(np.asarray(keys, np.uint64))
        mark = mark[:, None]
        return (self.table[one] == mark).any(1) | (self.table[two] == mark).any(1)

    def insert_all(self, keys: np.ndarray) -> bool:
        """All ``keys``, those that find a free slot in one of their two rows at once, the rest one by one; False if there is no room."""
        mark, one, two = self._place(keys)
        left = np.arange(len(keys))
        for row in (one, two):
            order = left[np.argsort(row[left], kind="stable")]
            at = row[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table == 0
            fits = nth < free.sum(1)[at]
            # The nth key of a row takes its nth free slot: slots in use sort last.
            slot = np.argsort(~free[at[fits]], 1, kind="stable")[np.arange(fits.sum()), nth[fits]]
            self.table[at[fits], slot] = mark[order[fits]]
            left = order[~fits]
        return all(self.insert(k) for k in keys[left])

    def insert(self, key: np.uint64) -> bool:
        """False if there is no room: then build a larger filter from the reference table."""
        mark, one, two = (x[0] for x in self._place(np.array([key], np.uint64)))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = one
        for turn in range(500):
            slot = turn % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int((np.uint64(at) ^ mix(np.array([mark], np.uint64))[0]) & np.uint64(len(self.table) - 1))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: np.uint64) -> bool:
        """Remove one copy of an inserted key; False if it isn't there."""
        mark, one, two = (x[0] for x in self._place(np.array([key], np.uint64)))
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False
