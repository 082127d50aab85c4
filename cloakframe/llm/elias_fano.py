"""Elias-Fano code of a rising sequence of numbers, with a select structure.

Of n numbers up to u, each keeps its lowest ``log2(u / n)`` bits in a packed array; the rest of all of them stands in a bit
string in unary, where the i-th set bit lies at ``(value >> low bits) + i``.  Together that is two bits and the low bits per number.
The place of every ``STEP``-th set bit is kept in 32 bits, so one number is found by reading on from the nearest of them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

STEP = 64
HEAD = struct.Struct("<IBQ")  # how many numbers, low bits of each, the first number


def _bits(data: np.ndarray, start: int, count: int) -> np.ndarray:
    """``count`` bits of a byte array from bit ``start``."""
    part = np.unpackbits(data[start // 8 : -(-(start + count) // 8)], bitorder="little")
    return part[start % 8 : start % 8 + count]


@dataclass
class EliasFano:
    n: int
    width: int
    first: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        """The code of non-falling 64-bit numbers (signed ones count from the first)."""
        n = len(values)
        if not n:
            return EliasFano(0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        plain = np.asarray(values).astype(np.int64).view(np.uint64)
        gaps = plain - plain[0]  # modulo 2^64, so any two signed numbers have their distance
        width = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        low = ((gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (gaps >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return EliasFano(
            n, width, int(plain[0]), np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.n, self.width, self.first) + self.low.tobytes() + self.samples.astype("<u4").tobytes() + self.high.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> EliasFano:
        n, width, first = HEAD.unpack_from(data)
        samples_at = HEAD.size + -(-n * width // 8)
        high_at = samples_at + 4 * -(-n // STEP)
        part = lambda a, b: np.frombuffer(data, np.uint8, b - a, a)
        samples = np.frombuffer(data, "<u4", (high_at - samples_at) // 4, samples_at)
        return EliasFano(n, width, first, part(HEAD.size, samples_at), part(high_at, len(data)), samples)

    def _signed(self, gap: int) -> int:
        whole = (gap + self.first) % (1 << 64)
        return whole - (1 << 64) if whole >> 63 else whole

    def select(self, i: int) -> int:
        """The place of the i-th set bit."""
        at, left = int(self.samples[i // STEP]), i % STEP
        while True:
            ones = np.flatnonzero(_bits(self.high, at, min(8 * STEP, 8 * len(self.high) - at)))
            if left < len(ones):
                return at + int(ones[left])
            at, left = at + 8 * STEP, left - len(ones)

    def __getitem__(self, i: int) -> int:
        """The i-th number, from a few bytes around it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = _bits(self.low, i * self.width, self.width)
        return self._signed(((self.select(i) - i) << self.width) + sum(1 << k for k in np.flatnonzero(low).tolist()))

    def values(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        low = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width).astype(np.uint64)
        lowest = (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        upper = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        return (upper + lowest + np.uint64(self.first)).view(np.int64)
