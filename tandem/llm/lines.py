"""Lines of many texts at once: byte ranges, and 128-bit hashes of their keys.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Works on the
UTF-8 bytes of a whole Arrow slice; there is no loop over lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tandem.llm.arrow import text_bytes
from tandem.llm.words import _LOWER, _SPACE, mix

_U = np.uint64
_TABLES = [np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | _U(1) for s in (11, 12)]
_STEPS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


@dataclass
class Lines:
    """Lines of a slice: ``first[d]:first[d + 1]`` are document ``d``'s, in order."""

    key: np.ndarray     # uint64 (n, 2), zero for an empty key
    chars: np.ndarray   # code points of the key
    first: np.ndarray   # int64, documents + 1
    start: np.ndarray   # byte range of each whole line in ``raw``
    end: np.ndarray
    raw: np.ndarray
    text: np.ndarray    # byte offset of each document, documents + 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_lines(col: pa.Array) -> Lines:
    """Split every text at ``\\n``; a null or empty text is one empty line."""
    raw, text = text_bytes(col)
    n, docs = len(raw), len(text) - 1
    nl = np.flatnonzero(raw == 10)
    count = np.diff(np.searchsorted(nl, text)) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    end = np.sort(np.concatenate([nl, text[1:]]))
    start = np.concatenate([[0], end[:-1] + 1])[:len(end)]
    start[first[:-1]] = text[:-1]
    solid = np.flatnonzero(~_SPACE[raw])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    has = np.flatnonzero(b > a)
    key = np.zeros((len(end), 2), np.uint64)
    chars = np.zeros(len(end), np.int64)
    if len(has):
        s, e = solid[a[has]], solid[b[has] - 1] + 1
        size = e - s
        # positions of all key bytes, line after line
        offs = np.concatenate([[0], np.cumsum(size)[:-1]])
        within = np.arange(int(size.sum())) - np.repeat(offs, size)
        body = raw[within + np.repeat(s, size)]
        for lane, (table, step) in enumerate(zip(_TABLES, _STEPS, strict=True)):
            p = np.full(int(size.max()), step)
            p[0] = 1
            h = table[body] * np.multiply.accumulate(p)[within]
            key[has, lane] = mix(np.add.reduceat(h, offs) ^ size.astype(np.uint64))
        chars[has] = np.add.reduceat(((body & 0xC0) != 0x80).astype(np.int64), offs)
    assert docs == len(first) - 1 and (not n or end[-1] == n)
    return Lines(key, chars, first, start, end, raw, text)


def document_keys(x: Lines, min_chars: int) -> np.ndarray:
    """Numbers of the lines that hold the first occurrence, in their document, of each key of at least
    ``min_chars`` code points."""
    at = np.flatnonzero(x.chars >= min_chars)
    doc = x.doc()[at]
    order = np.lexsort((at, x.key[at, 0], doc))
    at, doc = at[order], doc[order]
    if not len(at):
        return at
    new = np.append(True, (doc[1:] != doc[:-1]) | (x.key[at[1:], 0] != x.key[at[:-1], 0]))
    return at[new]
