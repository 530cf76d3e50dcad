"""Word shingles as 64-bit numbers, and exact comparisons of sets of them."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Odd multipliers for the places of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit matters for every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of ``width``-word shingles; the words' numbers are kept while the object lives."""

    class _Hashes(dict):
        def __missing__(self, word):
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    def __init__(self, width: int = 5, keep: int = 60_000):
        self.width, self.keep, self.hashes = width, keep, self._Hashes()

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted, distinct; a shorter text's whole sequence is one shingle; no words, no shingle."""
        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > self.keep:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out += mixed(h[i : len(h) - k + 1 + i] * PLACES[i])
        return np.unique(mixed(out))


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes())


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    inter = common(a, b)
    return inter > 0 and 100 * inter >= percent * (len(a) + len(b) - inter)
