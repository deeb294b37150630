"""Arrow helpers shared by the operators: bounded slices of a batch, raw text bytes, input frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.session import ship_package


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Exactly the named inputs, as ``new_name=source_column``: every other column of ``df``
    is left behind, so extra columns cannot clash with the ones an operator adds."""
    ship_package(df.sparkSession)
    return df.select(*[df[src].alias(new) for new, src in cols.items()])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the byte offset of each row (``len + 1``); null = empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def small_slices(batches: Iterator[pa.RecordBatch], col: int, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``max_bytes`` of text (a longer text is alone),
    so that the arrays built from one slice stay small however long the texts are."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = text_bytes(b.column(col))
        lo, n = 0, b.num_rows
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield b.slice(lo, hi - lo)
            lo = hi


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
