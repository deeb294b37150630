"""Words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, as 64-bit hashes, and hashes of word n-grams.

All functions work on the UTF-8 bytes of a whole Arrow slice; there is no loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tandem.llm.arrow import text_bytes

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[_SPACE] = 0
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = _U(0x9E3779B97F4A7C15)
_GRAM = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _STEP)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Words:
    """Words of a slice: ``first[d]:first[d + 1]`` are document ``d``'s, in order."""

    hash: np.ndarray    # uint64, one per word
    first: np.ndarray   # int64, documents + 1
    start: np.ndarray   # byte offset of each word in ``raw``
    end: np.ndarray     # byte offset just past it
    raw: np.ndarray     # the bytes of all texts
    text: np.ndarray    # byte offset of each document, documents + 1

    def __len__(self) -> int:
        return len(self.first) - 1


def split_words(col: pa.Array, lower: bool) -> Words:
    """Split and hash the words of every text; ``lower`` lower-cases A-Z first. Null = no words."""
    raw, text = text_bytes(col)
    n = len(raw)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        edge = text[:-1][text[:-1] < n]
        begin[edge] = inside[edge]
    start = np.flatnonzero(begin)
    first = np.searchsorted(start, text)
    if not len(start):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), first, empty, empty, raw, text)
    bounds = np.append(start, n)
    width = np.diff(bounds)
    spaces = np.zeros(n + 1, np.int64)
    np.cumsum(~inside, out=spaces[1:])
    end = start + width - (spaces[bounds[1:]] - spaces[start])
    at = np.arange(start[0], n) - np.repeat(start, width)
    h = (_BYTE_LOWER if lower else _BYTE)[raw[start[0]:]]
    h *= _powers(int(width.max()))[at]
    h = np.add.reduceat(h, start - start[0])
    return Words(mix(h ^ (end - start).astype(np.uint64)), first, start, end, raw, text)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and its validity (all ``k`` in one document)."""
    n = len(w.hash)
    ok = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), ok
    g = np.zeros(n, np.uint64)
    m = n - k + 1
    acc = w.hash[:m].copy()
    for j in range(1, k):
        acc *= _GRAM
        acc += w.hash[j:m + j]
    g[:m] = mix(acc ^ _U(k))
    last = np.repeat(w.first[1:], np.diff(w.first))
    ok[:] = np.arange(n) + k <= last
    return g, ok


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, repeats included, and their per-document starts.

    A document of ``k`` words or more has its ``k``-word shingles; a shorter one has its whole
    sequence as one shingle; one without words has none.
    """
    count = np.diff(w.first)
    g, ok = grams(w, k)
    short = np.flatnonzero((count > 0) & (count < k))
    for n in np.unique(count[short]):
        d = short[count[short] == n]
        at = w.first[d]
        acc = w.hash[at].copy()
        for j in range(1, int(n)):
            acc *= _GRAM
            acc += w.hash[at + j]
        g[at] = mix(acc ^ _U(n))
        ok[at] = True
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return g[ok], np.concatenate([[0], np.cumsum(per)])
