"""Word shingles as 64-bit fingerprints, and universal hash minima over them."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """Fingerprints of the words [^\\x20\\x09-\\x0D]+ of text, A-Z lower-cased; bytes.lower and bytes.split are ASCII only."""
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. Sorting whole numbers is faster here than numpy's own way by hashing."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """Fingerprints of the shingles of size words in order; fewer words are one shingle, no words none."""
    words = word_hashes(text)
    take = min(size, len(words))
    if not take:
        return words
    out = np.full(len(words) - take + 1, take, np.uint64)
    for k in range(take):
        out = mix(out * _ODD + words[k : len(words) - take + 1 + k])
    return out


class Minima:
    """Minima of many universal hash functions x -> a * x + b modulo 2**64, of which the high 32 bits count."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def of(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """uint32 minima, a row for each run of values that begins at starts; no run is empty."""
        out = np.empty((len(starts), len(self.a)), np.uint32)
        hashed = np.empty_like(values)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(values, a, out=hashed)
            np.add(hashed, b, out=hashed)
            out[:, k] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
        return out


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
