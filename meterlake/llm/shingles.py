"""Word shingles as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; holds at most ``limit`` words at a time."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rolling(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """The hash of each run of ``k`` words, in order; fewer words make one run; no words make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(k, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * _STEP + h[j : n - k + 1 + j])
    return acc


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(rolling(words_of(text), k, hashes))
