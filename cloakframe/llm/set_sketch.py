"""SetSketch registers: truncated minima on an exponential scale, mergeable, comparable by likelihood, bandable.

Register i of a set is ``floor(1 - log_b(min h_i))``, cut to 16 bits, where h_i maps elements to exponential values of rate
``RATE``.  The registers of a union are the larger ones of its parts.  With the sizes of two sets known, the numbers
of registers that are larger, smaller and equal give a likelihood of their Jaccard similarity (Ertl, "SetSketch", 2021).
"""

from __future__ import annotations

import numpy as np

from cloakframe.llm.shingles import ODD, mixed

BASE, RATE, TOP = 1.001, 20.0, 65535


def registers(elements: np.ndarray, sizes: np.ndarray, m: int, seed: int = 17) -> np.ndarray:
    """One row of m registers for each non-empty set; ``elements`` holds the sets one after another."""
    sizes = sizes[sizes > 0]
    out = np.zeros((len(sizes), m), np.uint16)
    if not len(sizes):
        return out
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    salts, factors = rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    work, high = np.empty_like(elements), np.empty_like(elements)
    for i in range(m):
        np.bitwise_xor(elements, salts[i], out=work)
        np.multiply(work, factors[i], out=work)
        np.right_shift(work, np.uint64(31), out=high)
        np.bitwise_xor(work, high, out=work)
        np.multiply(work, ODD[2], out=work)
        least = np.minimum.reduceat(work, starts)
        share = np.clip((least.astype(np.float64) + 0.5) / 2.0**64, 0, 1 - 1e-16)
        exponential = -np.log1p(-share) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    return out


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(first, second)


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per set and band of ``rows`` registers."""
    parts = found[:, : bands * rows].reshape(len(found), bands, rows).astype(np.uint64)
    keys = np.zeros((len(found), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mixed(keys * ODD[1] + parts[:, :, r])
    return keys.view(np.int64)


def similarity(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, steps: int = 40) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of sets, from their registers and sizes."""
    larger, smaller = (first > second).sum(axis=1), (first < second).sum(axis=1)
    equal = first.shape[1] - larger - smaller
    u = n_first / (n_first + n_second)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        def chance(x):  # that one register lies above the other
            return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

        up, down = chance(u - v * j), chance(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood has one maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = likelihood(a) < likelihood(b)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    return (low + high) / 2
