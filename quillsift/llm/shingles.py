"""Sets of word shingles as sorted 64-bit hashes, and their minimum signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Words whose hash a worker remembers.
REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_get = _Hashes().__getitem__


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    words = text.lower().split() if text else []
    return np.fromiter(map(_get, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; of fewer words, but not none, one hash of them all."""
    n = min(k, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * np.uint64(_ODD[j % 8] + 2 * (j // 8))
    return mix(out)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(runs(word_hashes(text), k))


class MinHash:
    """`size` minima of universal (multiply-shift) hashes."""

    def __init__(self, size: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 2**63, (size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, (size, 1), dtype=np.uint64)

    def signature(self, values: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(values), 2048):
            part = (self.a * values[None, at : at + 2048] + self.b).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return (least >> np.uint64(32)).astype(np.uint32)

    def bands(self, signature: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each band of `rows` minima; the band's number is part of it."""
        parts = signature.reshape(-1, rows).astype(np.uint64)
        key = np.arange(1, len(parts) + 1, dtype=np.uint64)
        for j in range(rows):
            key = mix(key + parts[:, j] * np.uint64(_ODD[j % 8]))
        return key
