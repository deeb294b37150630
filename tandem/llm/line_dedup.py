"""Line dedup: two Bloom filters find suspects, only those shuffle for an exact count.

Pass 1 marks each line key of a document in a *once-seen* filter; a key marked already goes to
the *twice-seen* filter (:mod:`tandem.llm.bloom`). Pass 2 keeps the lines that may be in it -- the
suspects -- and only their 128-bit key hashes shuffle, for the exact number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import pick, small_slices, text_bytes
from tandem.llm.bloom import contains, filter_bits, positions, twice_seen
from tandem.llm.lines import document_keys, split_lines
from tandem.llm.tables import written

_HASHES = 4


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                        id: str = "doc_id", text: str = "text",  # noqa: A002
                        bits_per_line: int = 8, max_bits: int = 1 << 27, with_text: bool = True,
                        carry: Sequence[str] = ()) -> DataFrame:
    """Remove the lines whose key is found in at least ``min_docs`` documents.

    Returns per row ``(doc_id, n_lines, n_dropped, kept_sha256[, kept])`` and, as the struct
    ``carried``, the columns of ``docs`` named in ``carry``. With ``keep_first``
    the first occurrence -- smallest (doc_id, line) -- of each such key stays. Keys shorter than
    ``min_chars`` code points are never dropped. Null or empty text: one empty line. Rows that
    share a doc_id (null is an id too) are one document in the count, and with ``keep_first``
    each of them keeps that line number; every row is returned. Each Bloom filter has
    ``bits_per_line`` bits a line, rounded up to a power of two, at most ``max_bits``; the twice
    filter is the only thing broadcast, so never over ``max_bits / 8`` bytes. Beyond that bound it
    lets more lines through to the exact count; results do not change.
    """
    base = pick(docs.withColumn(id, F.col(id).cast("long")), doc_id=id, text=text)
    sc = docs.sparkSession.sparkContext
    n_lines = base.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 1
    bits = filter_bits(n_lines, bits_per_line, max_bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in small_slices(batches, 1):
            x = split_lines(b.column(1))
            yield x.key[document_keys(x, min_chars)]

    seen = sc.broadcast(twice_seen(base, keys, bits, _HASHES))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(seen.value, np.uint8)
        for b in small_slices(batches, 1):
            x = split_lines(b.column(1))
            at = document_keys(x, min_chars)
            at = at[contains(twice, positions(x.key[at], bits, _HASHES))]
            doc = x.doc()[at]
            yield pa.record_batch([b.column(0).take(pa.array(doc)), *(pa.array(x.key[at, i].view(np.int64)) for i in (0, 1)),
                                   pa.array(at - x.first[doc])], names=["doc_id", "k1", "k2", "line"])

    found = written(base.mapInArrow(suspects, "doc_id long, k1 long, k2 long, line long"))
    common = (found.groupBy("k1", "k2").agg(F.count_distinct(F.struct("doc_id")).alias("n"),
                                            F.min(F.struct("doc_id", "line")).alias("first"))
              .where(F.col("n") >= min_docs).select("k1", "k2", "first"))
    first_line = F.when(F.col("first.doc_id").eqNullSafe(F.col("doc_id")), F.col("first.line"))
    lists = (found.join(common, ["k1", "k2"]).groupBy("doc_id")
             .agg(F.collect_set(F.struct("k1", "k2", F.coalesce(first_line, F.lit(-1)).alias("stay"))).alias("drops"))
             .withColumnRenamed("doc_id", "drop_id"))
    full = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"),
                       *([F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []))
    joined = full.join(lists, full["doc_id"].eqNullSafe(lists["drop_id"]), "left") \
        .select("doc_id", "text", *(F.col(f"drops.{c}").alias(c) for c in ("k1", "k2", "stay")), *["carried"] * bool(carry))
    more = f", carried {full.schema['carried'].dataType.simpleString()}" if carry else ""
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 1):
            marked = np.flatnonzero(b.column(2).is_valid())
            x = split_lines(b.column(1).take(pa.array(marked)))
            some = {}
            for j, d in enumerate(marked):
                k1, k2, stay = (b.column(c)[int(d)].values.to_numpy() for c in (2, 3, 4))
                lo, hi = x.first[j], x.first[j + 1]
                order = np.argsort(k1)
                at = np.minimum(np.searchsorted(k1, x.key[lo:hi, 0].view(np.int64), sorter=order), len(k1) - 1)
                at = order[at]
                gone = (k1[at] == x.key[lo:hi, 0].view(np.int64)) & (k2[at] == x.key[lo:hi, 1].view(np.int64)) & (x.chars[lo:hi] >= min_chars)
                if keep_first:
                    gone &= stay[at] != np.arange(hi - lo)
                kept = [x.raw[s:e].tobytes() for s, e in zip(x.start[lo:hi][~gone].tolist(), x.end[lo:hi][~gone].tolist(), strict=True)]
                some[int(d)] = (int(gone.sum()), b"\n".join(kept))
            raw, off = text_bytes(b.column(1))
            lines = np.diff(np.searchsorted(np.flatnonzero(raw == 10), off)) + 1
            rows = []
            for d in range(b.num_rows):
                n, kept = some.get(d) or (0, raw[off[d]:off[d + 1]].tobytes())
                rows.append((int(lines[d]), n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = list(zip(*rows, strict=True))[:3 + with_text]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, types, strict=False)] + b.columns[5:],
                                  names=names + b.schema.names[5:])

    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text + more)
