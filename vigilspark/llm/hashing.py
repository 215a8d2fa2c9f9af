"""Word hashing inside Arrow tasks: stable 64-bit hashes, mixed with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for combining neighbouring hashes.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything once it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * M2
    h = h ^ (h >> np.uint64(29))
    h = h * M3
    return h ^ (h >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * M1 + (b ^ (b >> np.uint64(31))) * M2 + np.uint64(1))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; a shorter text is one run of all its words, an empty one has none."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = pair(out, h[k : len(h) - n + 1 + k])
    return mix(out + np.uint64(n))
