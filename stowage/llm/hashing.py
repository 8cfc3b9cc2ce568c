"""Polynomial hashes of byte spans in numpy: one pass of prefix sums, then any span's hash in constant time.

The hash of bytes b[s:e] is the sum of code[b[i]] * BASE**(i - s) modulo 2**64, with random codes, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
WORD_GAP = np.zeros(256, dtype=bool)
WORD_GAP[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Prefix hashes of a byte array of at most `most` bytes; the powers are kept for the next array."""

    kept: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Prefix.kept[0]) < n:
            Prefix.kept = powers(BASE, n), powers(INVERSE, n)
        up, self.down = Prefix.kept[0][:n], Prefix.kept[1][:n]
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(CODES[data] * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text begins, with the end last."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no bound."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(inside))]
    start[cut] |= inside[cut]
    end = np.zeros(len(inside) + 1, dtype=bool)
    end[1:] = inside
    end[1:-1] &= ~inside[1:]
    end[cut] |= inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end)
