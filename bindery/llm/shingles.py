"""Hashed word shingles of a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ALNUM = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; the memory is cleared when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def space_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at blanks and the control characters 9 to 13."""
    return text.encode().lower().split()


def letter_words(text: str) -> list[bytes]:
    """Runs of letters and digits, lower-cased."""
    return [w.encode() for w in _ALNUM.findall(text.lower())]


def shingle_hashes(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Distinct shingles in ascending order of their 64-bit hashes; with fewer words than
    ``width`` the whole sequence is the only one; without words there is none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(w) - width + 1
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h = h * _MUL + w[i:i + n]
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of k hash functions, fixed by their number."""
    rng = np.random.default_rng(20_240_601)
    draw = rng.integers(0, 2**63, size=(2, k), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def minhash(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value under each function, as 32 bits; a piece of the set at a time."""
    a, b = functions
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i:i + 4096, None] * a + b
        best = np.minimum(best, (part ^ (part >> np.uint64(31))).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)
