"""Words and word shingles of a text as 64-bit hashes (numpy helpers that run inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words in a shingle.
SHINGLE_WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)


def words(text: str) -> list[bytes]:
    """Maximal runs without ``[\\x20\\x09-\\x0D]``, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_set(found: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words make one shingle; no words make none."""
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    width = min(SHINGLE_WORDS, len(h))
    rolled = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        rolled *= _ODD
        rolled += h[k : len(h) - width + 1 + k]
    return np.unique(mix(rolled + np.uint64(width)))


def digest(found: list[bytes]) -> bytes:
    """MD5 of the sequence of words, which Spark can compute too."""
    return hashlib.md5(b" ".join(found), usedforsecurity=False).digest()
