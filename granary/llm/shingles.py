"""Words and hashed word shingles of whole texts, for code that runs in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """64-bit hashes of words, each computed once; forgotten past a bound (200,000 take some 40 MB)."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: what the bytes methods do, and no more."""
    return (text or "").encode().lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit hashes. Fewer words: all of them as one; none: empty."""
    if not len(h):
        return h
    n, size = min(n, len(h)), max(1, len(h) - n + 1)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + size])
    return np.unique(out)
