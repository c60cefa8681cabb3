"""Word shingles as 64-bit hashes, vectorised with numpy over batches of texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        inv = pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_BASE))]).astype(np.uint64), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[U(1)], np.full(size, U(inv))]).astype(np.uint64), dtype=np.uint64)
    return _powers, _inverse


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """One hash for each word of UTF-8 bytes, A-Z lower-cased, in order."""
    gap = _SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    powers, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES_LOWER[raw] * powers[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words; fewer words make one shingle, no words none."""
    w = word_hashes(np.frombuffer(raw, dtype=np.uint8))
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    total = np.full(n, U(min(len(w), size)), dtype=np.uint64)
    for k in range(min(size, len(w))):
        total = mix(total + w[k : k + n]) if k % 2 else total * U(_BASE) + w[k : k + n]
    return np.unique(mix(total))
