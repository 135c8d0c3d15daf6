"""Hashes of word shingles, one document at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from bazaarspark.llm.text import words

_M = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. None is kept: looking one up takes longer than hashing, and a worker lives as long as its executor."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: each bit of the result depends on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's ``k``-word shingles.

    A text with fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = word_hashes(ws)
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _M + h[i : i + n]
    return np.unique(mix(out))


class Minima:
    """Minima of ``size`` universal hash functions a x + b over 32 bits, of a set of shingle hashes."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 256):  # a block stays in the cache
            np.minimum(least, (x[i : i + 256, None] * self.a + self.b).min(0), out=least)
        return least
