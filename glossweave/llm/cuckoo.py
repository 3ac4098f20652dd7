"""Cuckoo filter over 64-bit hashes: insert, delete and look up, with no false negatives."""

from __future__ import annotations

import numpy as np

from glossweave.llm.mph import mix

SLOTS, KICKS = 4, 200


class Cuckoo:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot.

    Two buckets are open to a key, and either follows from the other and the
    fingerprint.  A full filter doubles from the keys it is given: insert() returns
    False then, and the caller builds a larger one.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = 1 << max(0, int(buckets - 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        buckets = len(keys) // 3 + 1
        while True:
            filter_ = cls(buckets)
            if all(filter_.insert(k) for k in keys):
                return filter_
            buckets = filter_.buckets * 2

    @classmethod
    def read(cls, blob: bytes) -> Cuckoo:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def write(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(keys, np.uint64), 11)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(np.asarray(prints, np.uint64), 12) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, key: int) -> bool:
        prints, first, second = self._places(np.array([key], np.uint64))
        p, at = prints[0], int(first[0])
        for b in (at, int(second[0])):
            if (free := np.flatnonzero(self.table[b] == 0)).size:
                self.table[b, free[0]] = p
                return True
        undo = []
        for kick in range(KICKS):
            undo.append((at, kick % SLOTS, self.table[at, kick % SLOTS]))
            p, self.table[at, kick % SLOTS] = self.table[at, kick % SLOTS], p
            at = int(self._other(np.array([at]), np.array([p]))[0])
            if (free := np.flatnonzero(self.table[at] == 0)).size:
                self.table[at, free[0]] = p
                return True
        for b, slot, old in reversed(undo):
            self.table[b, slot] = old
        return False

    def delete(self, key: int) -> bool:
        """Of a key that was inserted; True if its fingerprint was there."""
        prints, first, second = self._places(np.array([key], np.uint64))
        for b in (int(first[0]), int(second[0])):
            if (own := np.flatnonzero(self.table[b] == prints[0])).size:
                self.table[b, own[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(axis=1) | (self.table[second] == prints[:, None]).any(axis=1)
