"""Hashed word and character n-gram features, computed for many words at once."""

from __future__ import annotations

from zlib import crc32

import numpy as np

from .common import mix64

_P = np.uint64(0x100000001B3)


def word_hashes(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))


def char_ngrams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word number, at the front?) of every character n-gram; a word's ends count as a character."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = points == 32
    owner = np.cumsum(edge) - 1
    grams, owners, fronts = [], [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            inside = np.ones(m, bool)
            for k in range(n):
                h = h * _P + points[k : k + m]
                if 0 < k < n - 1:
                    inside &= ~edge[k : k + m]
            if n == 1:
                inside = ~edge
            inside &= owner[:m] < len(words)
            grams.append(mix64(h[inside]) % np.uint64(buckets))
            owners.append(owner[:m][inside])
            fronts.append(edge[:m][inside])
    return np.concatenate(grams).astype(np.int64), np.concatenate(owners), np.concatenate(fronts)
