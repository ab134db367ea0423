"""Caches from a word to a value that workers compute once, and hashes of words and of word runs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash

try:  # glibc keeps freed memory for itself until it is asked
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None

#: A cache is emptied between batches when it holds more words than this, unless it is made with another bound.
CACHE_WORDS = 200_000


_caches: list[Cache] = []


def release(keep: Cache | None = None) -> None:
    for cache in _caches:
        if cache is not keep and len(cache) > len(cache.base):
            cache.clear()
            cache.update(cache.base)
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Cache(dict):
    """``cache[word]`` computes a missing value and keeps it."""

    def __init__(self, make: Callable, base: dict | None = None, most: int = CACHE_WORDS):
        super().__init__(base or {})
        self.make, self.base, self.most = make, base or {}, most
        _caches.append(self)

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def use(self, most: int | None = None) -> None:
        """Empty the other caches of this worker, which another step's tasks have left, and from now on hold ``most`` words."""
        self.most = most or self.most
        self.trim()
        release(self)

    def trim(self) -> None:
        if len(self) > len(self.base) + self.most:
            self.clear()
            self.update(self.base)

    def learn(self, words: Iterable, make_many: Callable) -> None:
        """Fill in the words that are missing, in one call of the library."""
        if missing := list(set(words).difference(self)):
            self.update(zip(missing, make_many(missing), strict=True))


word_hash = xxhash.xxh3_64_intdigest


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` consecutive words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * _STEP + h[i : i + n]
    return mixed(out)
