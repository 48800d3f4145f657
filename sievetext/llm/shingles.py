"""Word shingles of whole texts as sets of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; on UTF-8 bytes these
are exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
WORDS = 5
#: Words whose hashes a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> row in ``values``, its 64-bit hash."""

    def __init__(self) -> None:
        super().__init__()
        self.values_ = np.empty(1 << 16, U64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.values_):
            self.values_ = np.concatenate([self.values_, np.empty(row, U64)])
        self.values_[row] = xxhash.xxh64_intdigest(word)
        self[word] = row
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.values_[rows]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    rolled = np.zeros(n - width + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = mix(rolled * U64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return np.unique(rolled)
