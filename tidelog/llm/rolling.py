"""Rabin-Karp hashes of all windows of words, vectorised over many documents at once."""

from __future__ import annotations

import numpy as np

#: An odd base (5 modulo 8, so powers differ in few low bits) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C1D
INVERSE = pow(BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, position among all words) of each window of ``width`` words inside one document."""
    n = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), n)
    return doc, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of words[start:end], from running sums: the same for equal sequences anywhere."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(BASE, len(words)), out=sums[1:], dtype=np.uint64)
    return (sums[end] - sums[start]) * _powers(INVERSE, len(words) + 1)[start]
