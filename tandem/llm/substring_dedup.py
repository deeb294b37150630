"""Repeated passages across documents by De Bruijn compaction.

Every window of ``k`` words is an edge between its first and last ``k - 1`` words. Consecutive edges
of a document that have the same minimizer (the smallest hash of the ``ANCHOR``-word runs in them)
form a piece of a path without a branch in it; the cut points depend on the words only, so documents
that share a passage share its inner pieces. A piece travels once, to the task of its minimizer; all
that is compared with it is there. Where a minimizer has equal pieces only, they compact into one
path, an edge of its own. Where it has several paths (a branch, or a passage's ragged end) they are
opened into edges. Each edge gets the smallest source of all, which gives the windows to remove.

Two lengths of paths are compacted one after the other. A chunk is a run of pieces up to one whose
minimizer is marked by its hash, some 40 edges long. Copies of a chunk other than its smallest source are
repeated as a whole and need no look at their pieces: every edge of them is in that source too. So
only each chunk's smallest source is cut into pieces.

A twice-seen Bloom filter of chunks, then of minimizers, of bounded size, keeps the pieces of unrepeated text from
being shuffled at all; it never loses a repeated one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.arrow import pick, small_slices
from tandem.llm.bloom import contains, filter_bits, positions, twice_seen
from tandem.llm.words import Words, grams, mix, split_words
from tandem.llm.tables import written

_U = np.uint64
ANCHOR = 5
MAX_EDGES = 32
#: One piece in so many starts a chunk.
CHUNK = 8
_HASHES = 2
_SALTS = (_U(0x8CB92BA72F3D8DD7), _U(0x5851F42D4C957F2D))
_ROLL = _U(0xD6E8FEB86659FD93)
_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"


def _windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, minimizer and document of every window of ``k`` words."""
    n = len(w.hash)
    doc = np.repeat(np.arange(len(w)), np.diff(w.first))
    anchor = min(ANCHOR, k)
    g, _ = grams(Words(w.hash, np.array([0, n]), w.start, w.end, w.raw, w.text), anchor)
    at = np.flatnonzero(np.arange(n) + k <= w.first[doc + 1]) if n else np.zeros(0, np.int64)
    width = k - anchor + 1
    m, have = g, 1
    while have * 2 <= width:
        m = np.minimum(m[:len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(m) - (width - have)], m[width - have:])
    return at, m[at], doc[at]


def _pieces(at: np.ndarray, m: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Start (index into the windows) of each piece: a run with one document and one minimizer, cut
    every ``MAX_EDGES`` windows."""
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.flatnonzero(run % MAX_EDGES == 0)


def _chunks(w: Words, k: int, at: np.ndarray, m: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First piece, number of windows and two 64-bit digests of the words of every chunk."""
    new = mix(m[p] ^ _SALTS[0]) % _U(CHUNK) == 0
    new[:1] = True
    new[1:] |= doc[p][1:] != doc[p][:-1]
    c = np.flatnonzero(new)
    begin = p[c]
    n = np.diff(np.append(begin, len(at)))
    if not len(c):
        return c, n, np.zeros((0, 2), np.uint64)
    step = np.arange(len(at)) - np.repeat(begin, n)
    tail = n.astype(np.uint64)                      # the last window; the sums below have the first words of all
    for j in range(k):
        tail = tail * _ROLL + w.hash[at[begin + n - 1] + j]
    place = np.arange(int(n.max()), dtype=np.uint64)
    return c, n, np.stack([mix(np.add.reduceat(mix(w.hash[at] ^ mix(place + x)[step]), begin) ^ mix(tail + x)) for x in _SALTS], 1)


def _sources(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filter keys of (chunk, document)."""
    return np.stack([mix(keys[:, 0] ^ mix(ids.view(np.uint64))), mix(keys[:, 1] + ids.view(np.uint64))], 1)


def repeated_windows(docs: DataFrame, k: int = 13, bits_per_key: int = 8, max_bits: int = 1 << 27) -> DataFrame:
    """``docs(doc_id, th, text)`` -> ``(doc_id, th, start, n, mask, src)``: the ``n`` windows from word ``start``
    on, or where ``n`` is 0 those at ``start + i`` for every bit ``i`` of ``mask``, also start in a document
    with a smaller id; ``src`` has one of all ``n``, or the smallest of each window. ``th`` tells rows of one id apart."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    words = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", _BREAKS, "")) + 1)).first()[0] or 1
    n_pieces = 2 * words // (k - min(ANCHOR, k) + 2)
    bits = filter_bits(n_pieces, bits_per_key, max_bits)
    chunk_bits = filter_bits(2 * n_pieces // CHUNK, bits_per_key, max_bits)

    def chunked(batches: Iterator[pa.RecordBatch]):
        for b in small_slices(batches, 2, 1 << 20):
            w = split_words(b.column(2), lower=False)
            at, m, doc = _windows(w, k)
            p = _pieces(at, m, doc)
            yield b, w, at, m, doc, p, *_chunks(w, k, at, m, doc, p)

    def chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, _, doc, p, c, _, key in chunked(batches):
            yield key[np.unique(np.stack([key[:, 0], doc[p[c]].astype(np.uint64)], 1), axis=0, return_index=True)[1]]

    often = spark.sparkContext.broadcast(twice_seen(known, chunk_keys, chunk_bits, _HASHES))

    def rows_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(often.value, np.uint8)
        for b, w, at, _, doc, p, c, n, key in chunked(batches):
            some = contains(twice, positions(key, chunk_bits, _HASHES))
            first = p[c][some]
            d = doc[first]
            yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(key[some].T)), *(b.column(i).take(pa.array(d)) for i in (0, 1)),
                                   pa.array((at[first] - w.first[d]).astype(np.int64)), pa.array(n[some].astype(np.int64))],
                                  names=["c1", "c2", "doc_id", "th", "start", "n"])

    chunks = written(known.mapInArrow(rows_of_chunks, "c1 long, c2 long, doc_id long, th long, start long, n long"))
    firsts = written(chunks.groupBy("c1", "c2").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last")))
    copies = (chunks.join(firsts.where("src < last").drop("last"), ["c1", "c2"]).where("src < doc_id")
              .select("doc_id", "th", "start", "n", F.lit(0).cast("long").alias("mask"), F.array("src").alias("src")))
    source_bits = filter_bits(firsts.count(), 16, max_bits)

    def source_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            c1, c2, src = (x.to_numpy() for x in b.columns)
            yield np.repeat(_sources(np.stack([c1, c2], 1).view(np.uint64), src), 2, axis=0)   # twice: the filter is of keys seen twice

    smallest_sources = spark.sparkContext.broadcast(twice_seen(firsts.select("c1", "c2", "src"), source_keys, source_bits, _HASHES))

    def sources_only(batches: Iterator[pa.RecordBatch]):
        """Slices with their windows and the pieces to look at. A chunk of the first filter is in ``firsts``, so
        one that is not in the second is a copy for certain; a chance member is looked at for nothing."""
        twice, first = (np.frombuffer(x.value, np.uint8) for x in (often, smallest_sources))
        for b, w, at, m, doc, p, c, _, key in chunked(batches):
            ids = b.column(0).to_numpy()[doc[p[c]]]
            copy = contains(twice, positions(key, chunk_bits, _HASHES)) & ~contains(first, positions(_sources(key, ids), source_bits, _HASHES))
            yield b, w, at, m, doc, p, ~np.repeat(copy, np.diff(np.append(c, len(p))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, m, doc, p, look in sources_only(batches):
            m, doc = m[p[look]], doc[p[look]]
            order = np.lexsort((doc, m))
            m, doc = m[order], doc[order]
            new = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))[:len(m)]
            yield np.stack([mix(m[new]), m[new]], 1)

    seen = spark.sparkContext.broadcast(twice_seen(known, keys, bits, _HASHES))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(seen.value, np.uint8)
        for b, w, at, m, doc, p, look in sources_only(batches):
            keep = look & contains(twice, positions(np.stack([mix(m[p]), m[p]], 1), bits, _HASHES))
            size = np.diff(np.append(p, len(at)))[keep]
            p = p[keep]
            g, _ = grams(w, k)
            total = int(size.sum())
            pick_ = np.repeat(p - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(p) else p, size) + np.arange(total)
            edges = g[at[pick_]]
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            d = doc[p]
            yield pa.record_batch([pa.array(m[p].view(np.int64)), b.column(0).take(pa.array(d)), b.column(1).take(pa.array(d)),
                                   pa.array((at[p] - w.first[d]).astype(np.int64)),
                                   pa.ListArray.from_arrays(pa.array(offs), pa.array(edges.view(np.int64)))],
                                  names=["m", "doc_id", "th", "start", "edges"])

    # one exchange, by the minimizer: the windows and the grouping below it keep its partitions
    of_m, of_edge = Window.partitionBy("m"), Window.partitionBy("m", "e")
    found = known.mapInArrow(pieces, "m long, doc_id long, th long, start long, edges array<long>").withColumn("n", F.size("edges"))
    paths = (found.withColumn("low", F.min("doc_id").over(of_m)).withColumn("top", F.max("doc_id").over(of_m)).withColumn("path", F.xxhash64("edges"))
             .withColumn("branches", F.min("path").over(of_m) < F.max("path").over(of_m)).where("low < top").drop("low", "top"))
    # a path without branches is one edge of its own
    opened = paths.select("m", "doc_id", "th", "start", "n", "branches", F.posexplode(F.when(F.col("branches"), F.col("edges")).otherwise(F.array("path"))).alias("i", "e"))
    lows = (opened.withColumn("low", F.min("doc_id").over(of_edge)).where("low < doc_id").groupBy("m", "doc_id", "th", "start", "n", "branches")
            .agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"), F.min("low").alias("src"), F.collect_set(F.struct("i", "low")).alias("lows")))
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at(F.map_from_entries("lows"), i), "doc_id"))
    return lows.select("doc_id", "th", "start", F.lit(0).cast("long").alias("n"),
                       F.when(F.col("branches"), F.col("bits")).otherwise(F.expr("shiftleft(1L, n) - 1")).alias("mask"),
                       F.when(F.col("branches"), each).otherwise(F.array_repeat("src", F.col("n"))).alias("src")).unionByName(copies)


def drop_repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 13,  # noqa: A002
                           with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` per row: the words covered by a window of
    ``k`` consecutive words that also starts in a document with a smaller id are removed.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. ``kept`` is the other
    words joined by one space. Null, empty or short texts have no window. Rows that share an id are one
    document: neither is smaller. A row with a null id is neither source nor changed; an
    empty table gives no rows. Windows are told apart by two 64-bit hashes (of the window and of its
    minimizer).
    """
    rows = pick(docs.withColumn(id, F.col(id).cast("long")), doc_id=id, text=text) \
        .select("doc_id", F.xxhash64("text").alias("th"), "text")
    marks = written(repeated_windows(rows, k).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "mask")).alias("marks")))
    # only documents that may have marks shuffle to meet them; a Bloom filter of bounded size tells the rest
    bits = filter_bits(marks.count(), 16, 1 << 27)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield np.repeat(_row_keys(b), 2, axis=0)        # twice: the filter is of keys seen twice

    some = rows.sparkSession.sparkContext.broadcast(twice_seen(marks.select("doc_id", "th"), marked, bits, _HASHES))

    def only(yes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                may = contains(np.frombuffer(some.value, np.uint8), positions(_row_keys(b), bits, _HASHES))
                yield b.filter(pa.array(may == yes))

        return rows.mapInArrow(run, "doc_id long, th long, text string")

    none = F.lit(None).cast("array<long>")
    joined = only(True).join(marks.toDF("mark_id", "mark_th", "marks"),
                             (F.col("doc_id") == F.col("mark_id")) & (F.col("th") == F.col("mark_th")), "left") \
        .select("doc_id", "text", F.col("marks.start").alias("starts"), F.col("marks.n").alias("ns"), F.col("marks.mask").alias("masks"))
    rest = only(False).select("doc_id", "text", none.alias("starts"), none.alias("ns"), none.alias("masks"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 1):
            w = split_words(b.column(1), lower=False)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            for c in range(b.num_rows):
                if b.column(2)[c].is_valid:
                    base = w.first[c]
                    starts = b.column(2)[c].values.to_numpy() + base
                    whole, masks = (b.column(i)[c].values.to_numpy() for i in (3, 4))
                    np.add.at(gone, starts[whole > 0], 1)
                    np.add.at(gone, (starts + whole + k - 1)[whole > 0], -1)
                    for i in range(MAX_EDGES):
                        s = np.unique(starts[(masks >> i) & 1 == 1]) + i    # repeated rows of one document repeat their marks
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + k, -1)
            gone = np.cumsum(gone[:-1]) > 0
            raw = w.raw
            rows_ = []
            for x, y in zip(w.first, w.first[1:], strict=False):
                stay = np.flatnonzero(~gone[x:y]) + x
                kept = b" ".join([raw[s:e].tobytes() for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)])
                rows_.append((int(y - x), int(y - x - len(stay)), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*rows_, strict=True))[:3 + with_text]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return joined.mapInArrow(cut, schema).unionByName(rest.mapInArrow(cut, schema))


def _row_keys(b: pa.RecordBatch) -> np.ndarray:
    """Key halves of ``(doc_id, th)`` rows; a null id is like 0 (a chance member at most)."""
    i, t = (b.column(c).fill_null(0).to_numpy().view(np.uint64) for c in (0, 1))
    return np.stack([mix(i ^ mix(t)), mix(t + i)], 1)
