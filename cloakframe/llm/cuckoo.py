"""A cuckoo filter over 128-bit keys: insert, delete, and a vectorised test.

Four 16-bit slots per bucket; a key's second bucket follows from the first and the fingerprint, so entries can move and
be deleted without the key.  A key that was inserted is always found; an absent one is found with probability about
8 / 65536.
"""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.85 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> CuckooFilter:
        """A filter with room for these distinct keys, holding them."""
        room = len(high)
        while True:
            made = cls(room)
            if made.insert(high, low):
                return made
            room = 2 * max(room, 1)

    def places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key (two int64 halves)."""
        last = np.uint64(len(self.table) - 1)
        marks = (low.astype(np.int64).view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (high.astype(np.int64).view(np.uint64) >> np.uint64(7)) & last
        return marks, first.astype(np.int64), self.other(first, marks).astype(np.int64)

    def other(self, bucket, mark):
        last = np.uint64(len(self.table) - 1)
        with np.errstate(over="ignore"):
            return (np.asarray(bucket, np.uint64) ^ ((np.asarray(mark, np.uint64) * _MIX) >> np.uint64(20))) & last

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Insert distinct keys; False if the table is too full (it then lacks some of them)."""
        table = self.table
        rng = np.random.default_rng(len(high))
        for mark, *both in zip(*(x.tolist() for x in self.places(high, low))):
            for bucket in both:
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = mark
                    break
            else:
                bucket = both[int(rng.integers(2))]
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    mark, table[bucket, slot] = int(table[bucket, slot]), mark
                    bucket = int(self.other(bucket, mark))
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Delete keys that were inserted before, one entry each."""
        for mark, *both in zip(*(x.tolist() for x in self.places(high, low))):
            for bucket in both:
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(high, low)
        marks = marks[:, None]
        return (self.table[first] == marks).any(axis=1) | (self.table[second] == marks).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return made
