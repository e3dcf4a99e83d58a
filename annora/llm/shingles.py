"""Word shingles of whole texts as sets of 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


class _Numbers(dict):
    """The number of each word, remembered for a bounded number of words."""

    most = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_numbers = _Numbers()


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of width words, ascending; a text of fewer words has its whole sequence as one shingle, one without words none.

    Shingles are 64-bit hashes, so that sets are exact but for collisions (about one pair of different shingles in 10**19).
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))
    k = min(width, len(a))
    m = len(a) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h ^= a[j : j + m]
        h *= _P
        h ^= h >> _SHIFT
    h *= _Q
    h ^= h >> _SHIFT
    return np.unique(h)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of the set."""
    return int(np.array([xxhash.xxh3_64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])
