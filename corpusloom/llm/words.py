"""Words and word hashes of whole Arrow batches, as flat NumPy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix) over an array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHasher:
    """Stable 64-bit hashes of words, remembered for the words met before."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return [known[w] for w in words]


def shingle_hashes(word_hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that lie within one owner, and their owners."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(3) + word_hashes[k : n + k] + _GOLD)
    inside = owner[:n] == owner[width - 1 :]
    return h[inside], owner[:n][inside]
