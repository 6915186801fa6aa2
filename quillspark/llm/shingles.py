"""Multisets of word shingles as numpy arrays, hashed alike in every worker."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash for each window of ``width`` lower-cased words; a shorter text is one window."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = mix(out + _STEP + h[k : k + n])
    return out


def multiset(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and how often each occurs."""
    return np.unique(word_shingles(text, width), return_counts=True)


def occurrences(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set whose plain overlaps equal the multiset's: each occurrence has a number of its own."""
    if counts.size == 0 or counts.max() == 1:
        return mix(shingles + _STEP)
    each = np.repeat(shingles, counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    number = (np.arange(each.size) - first).astype(np.uint64) + np.uint64(1)
    return mix(each + number * _STEP)
