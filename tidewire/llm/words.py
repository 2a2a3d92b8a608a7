"""Words as 64-bit hashes, and hashes of runs of words, by whole numpy columns."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words that a Python worker remembers; it starts anew beyond them, so its memory has a bound.
MAX_WORDS = 400_000


class WordHashes(dict):
    """word -> 64-bit hash, filled as words are asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(k: int, seed: int) -> np.ndarray:
    """k odd 64-bit numbers."""
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """For each start of k consecutive words, the hash of their sequence."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    m = multipliers(k, seed)
    total = hashes[:n] * m[0]
    for j in range(1, k):
        total += hashes[j : j + n] * m[j]
    return mix(total)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; with fewer words the whole sequence is one; no words, none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hash_words(words)
    return np.unique(run_hashes(h, k) if len(words) >= k else run_hashes(h, len(words), seed=len(words)))
