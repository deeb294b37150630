"""A pair of Bloom filters over a table: keys seen once, and keys seen in two documents or more.

Each task marks its own keys; its filters travel in compressed slices and are merged slice by
slice -- bits of both *once* filters also go to *twice* -- so no task holds all of them. A key of
two documents is always in the merged twice filter; others are in it by chance only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SLICES = 64


def filter_bits(keys: int, bits_per_key: int, max_bits: int) -> int:
    """``bits_per_key`` bits a key, rounded up to a power of two, at most ``max_bits`` (a power of two
    too; every slice has a byte at least)."""
    return max(8 * SLICES, min(max_bits, max(1 << 16, 1 << (bits_per_key * max(keys, 1) - 1).bit_length())))


def positions(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """``(n, hashes)`` bit numbers of ``(n, 2)`` 64-bit key halves, by double hashing."""
    step = keys[:, 1:] | np.uint64(1)
    return ((keys[:, :1] + step * np.arange(hashes, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def contains(packed: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which rows of ``p`` have all their bits set in a packed filter."""
    return ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(1)


def twice_seen(docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
               bits: int, hashes: int) -> bytes:
    """The merged twice-seen filter, ``bits / 8`` bytes.

    ``keys_of`` turns a partition's batches into ``(n, 2)`` arrays of keys, each key once for every
    document that has it.
    """
    each = bits // SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.zeros((0, 2), np.uint64), *keys_of(batches)]
        k = np.concatenate(keys)
        del keys
        if not len(k):
            return
        _, at, count = np.unique(k[:, 0], return_index=True, return_counts=True)
        once = np.unique(positions(k[at], bits, hashes))
        twice = np.unique(positions(k[at[count > 1]], bits, hashes))
        z = zstandard.ZstdCompressor(level=1)
        for s in np.unique(once // each):
            packed = []
            for marks in (once, twice):
                m = np.zeros(each, bool)
                m[marks[np.searchsorted(marks, s * each):np.searchsorted(marks, (s + 1) * each)] - s * each] = True
                packed.append(pa.array([z.compress(np.packbits(m).tobytes())], pa.binary()))
            yield pa.record_batch([pa.array([s], pa.int32()), *packed], names=["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, t = (np.frombuffer(z.decompress(x), np.uint8) for x in (o, t))
                if s in held:
                    once, twice = held[s]
                    twice |= t
                    twice |= once & o
                    once |= o
                else:
                    held[s] = [o.copy(), t.copy()]
        c = zstandard.ZstdCompressor(level=1)
        for s, (_, twice) in held.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([c.compress(twice.tobytes())], pa.binary())],
                                  names=["slice", "twice"])

    parts = (docs.mapInArrow(build, "slice int, once binary, twice binary")
             .repartition(SLICES, "slice").mapInArrow(merge, "slice int, twice binary"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():  # at most bits / 8 bytes in all, a parameter
        out[r.slice * each // 8:(r.slice + 1) * each // 8] = zstandard.ZstdDecompressor().decompress(r.twice)
    return bytes(out)
