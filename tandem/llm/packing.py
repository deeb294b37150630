"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens. An instance of bin packing is fully
described by how many pieces there are of each length: at most ``capacity`` numbers, whatever the
table's size. The driver packs that histogram, whole groups of equal bins at a time: bins proven to
dominate all others of their longest piece are fixed first, the rest goes best-fit. Spark tokenises, counts, numbers the
pieces of each length and joins each with its place.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.arrow import pick, small_slices
from tandem.llm.tables import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str):
    """A function text -> token ids (no special tokens added), as ``tokenizers`` gives for ``path``.

    A byte-level BPE vocabulary is read once more as tiktoken ranks, whose merges are several
    times as fast and give the same ids; texts that hold one of the file's special-token strings
    are left to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return tok.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_pieces(ids: list[int], capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, unless it is longer than ``capacity``; then
    all but the first hold ``capacity`` tokens."""
    head = len(ids) % capacity or capacity
    starts = [0, *range(head, len(ids), capacity)]
    return list(zip(starts, [y - x for x, y in zip(starts, [*starts[1:], len(ids)], strict=True)], strict=True))


def token_pieces(docs: DataFrame, capacity: int, separator: int, tokenizer: str | None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece. Null text is empty: the separator alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer or default_tokenizer())
        for b in small_slices(batches, 1):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t or "")
                ids.append(separator)
                raw = np.array(ids, "<u4")
                rows += [(i, p, s, n, zlib.crc32(raw[s:s + n].tobytes())) for p, (s, n) in enumerate(cut_pieces(ids, capacity))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECES)


def pack_histogram(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as ``(how many, [(length, copies), ...])``, each a group of equal bins.

    Bins that :func:`reduce_dominated` proves are fixed; the remainder is packed best-fit decreasing. Where that needs more
    bins than the remainder's tokens fill, the remainder is also packed bin by bin, the longest piece with
    the subset that fits its room best, and the better of the two is taken."""
    bins, left = reduce_dominated(count, capacity)
    rest = _best_fit(left, capacity)
    if sum(m for m, _ in rest) > -(-sum(n * c for n, c in left.items()) // capacity):
        rest = min(rest, _best_filled(left, capacity), key=lambda r: sum(m for m, _ in r))
    return bins + rest


def reduce_dominated(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Fixed bins and the remaining instance, by Martello and Toth's dominance: their bins together are optimal if the rest is.

    For a piece ``a`` let ``x`` be the longest other piece that fits beside it and ``y`` the longest that fits beside both.
    The bin is ``{a}`` if nothing fits; ``{a, x}`` if it is full, or if no two others fit beside ``a``. If two fit but
    never three, every other bin of ``a`` holds at most a pair ``r >= s``: its pieces can take the places of ``x`` and ``y``
    if ``s <= y``, or both that of ``x`` if ``r + s <= x``. If that holds for all pairs, ``{a, x, y}`` (without ``y``, if
    none fits) dominates them. Lengths are tried from the longest down, all that remain are what may fit, and
    a bin is fixed as many times as its pieces last: fewer pieces only leave fewer pairs to beat.
    """
    left = {n: c for n, c in count.items() if c > 0}
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    for a in sorted(left, reverse=True):
        while left.get(a):
            bin_ = _dominant(sorted(left), left, a, capacity - a)
            if bin_ is None:
                break
            use = {n: bin_.count(n) for n in bin_}
            many = min(left[n] // c for n, c in use.items())
            bins.append((many, sorted(use.items(), reverse=True)))
            for n, c in use.items():
                left[n] -= many * c
                if not left[n]:
                    del left[n]
    return bins, left


def _dominant(sizes: list[int], left: dict[int, int], a: int, room: int) -> list[int] | None:
    """The pieces of a bin with ``a`` that dominates all others, or None without a proof."""
    spare = lambda n, *used: left[n] - (a, *used).count(n) > 0
    fits = [n for n in sizes if n <= room and spare(n)]
    if not fits:
        return [a]
    x = fits[-1]
    few = [n for n in fits[:3] for _ in range(min(3, left[n] - (n == a)))]
    if x == room or len(few) < 2 or few[0] + few[1] > room:
        return [a, x]
    if len(few) > 2 and sum(few[:3]) <= room:
        return None
    y = max((n for n in fits if n <= room - x and spare(n, x)), default=0)
    lo, hi = 0, len(fits) - 1
    while lo <= hi:                     # for every smaller piece over y, the longest partner within the room
        small, long = fits[lo], fits[hi]
        if small + long > room:
            hi -= 1
        else:
            if small > y and small + long > x and (small != long or spare(small, small)):
                return None
            lo += 1
    return [a, x, y] if y else [a, x]


def _best_filled(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin by bin: the longest piece and the subset of the others that fills its room best (longer pieces first among
    equals), found with bit sets of reachable totals; a bin is repeated as long as its pieces last."""
    left, bins = dict(left), []
    while left:
        a = max(left)
        room = capacity - a
        parts, reach = [], [1]
        for n in sorted((n for n in left if n <= room), reverse=True):
            copies, step = min(left[n] - (n == a), room // n), 1
            while copies > 0:
                step = min(step, copies)
                copies -= step
                parts.append((n, step))
                reach.append((reach[-1] | reach[-1] << n * step) & ((2 << room) - 1))
                step *= 2
        total, use = reach[-1].bit_length() - 1, {a: 1}
        for (n, step), before in zip(reversed(parts), reversed(reach[:-1]), strict=True):
            if not before >> total & 1:
                use[n] = use.get(n, 0) + step
                total -= n * step
        many = min(left[n] // c for n, c in use.items())
        bins.append((many, sorted(use.items(), reverse=True)))
        for n, c in use.items():
            left[n] -= many * c
            if not left[n]:
                del left[n]
    return bins


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on groups of equal bins: the same bins as one piece at a time."""
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)   # room left -> groups
    for n in sorted(left, reverse=True):
        c = left[n]
        for room in sorted(r for r in open_ if r >= n):
            groups = open_.pop(room)
            each = room // n
            while groups and c:
                bins, items = groups.pop()
                whole = min(bins, c // each)
                if whole:
                    open_[room - whole_len(each, n)].append((whole, (*items, (n, each))))
                    c -= whole * each
                    bins -= whole
                if bins and c:
                    open_[room - whole_len(c, n)].append((1, (*items, (n, c))))
                    bins -= 1
                    c = 0
                if bins:
                    groups.append((bins, items))
            if groups:
                open_[room] += groups
            if not c:
                break
        if c:
            each = capacity // n
            if c // each:
                open_[capacity - whole_len(each, n)].append((c // each, ((n, each),)))
            if c % each:
                open_[capacity - whole_len(c % each, n)].append((1, ((n, c % each),)))
    return [(bins, list(items)) for groups in open_.values() for bins, items in groups]


def whole_len(copies: int, length: int) -> int:
    """Tokens of ``copies`` pieces of ``length``."""
    return copies * length


def placements(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, past the last, first sequence, copies a bin, offset) per group and length:
    the pieces of a length are dealt to the groups in order of their numbers."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for many, items in bins:
        offset = 0
        for n, copies in items:
            out.append((n, used[n], used[n] + many * copies, sequence, copies, offset))
            used[n] += many * copies
            offset += n * copies
        sequence += many
    return out


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, separator: int = 0,  # noqa: A002
         tokenizer: str | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its token ids and ``separator``; one longer than ``capacity`` is cut, see
    :func:`cut_pieces`. Null and empty texts are the separator alone. Repeated rows and repeated or
    null ids are documents of their own. Every token of every document is placed; an empty table
    gives no rows. Pieces of one length are numbered in hash buckets of about ``bucket_rows``, so a
    length that most pieces share is many small groups. ``ids_crc32`` is the unsigned CRC-32 of the
    piece's ids as little-endian unsigned 32-bit numbers.
    """
    base = pick(docs.withColumn(id, F.col(id).cast("long")), doc_id=id, text=text)
    pieces = written(token_pieces(base, capacity, separator, tokenizer))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    rows = placements(pack_histogram(histogram, capacity))
    n_buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    order = ["doc_id", "piece", "ids_crc32", "start"]
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)))
    w = Window.partitionBy("length", "bucket").orderBy(*order)
    numbered = placed.withColumn("at", F.row_number().over(w) - 1)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
               .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    plan = docs.sparkSession.createDataFrame(rows, "length long, lo long, hi long, first long, copies long, at_token long")
    spots = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "copies", "at_token"))).alias("spots"))
    # one row a length and one struct a (bin group, length): bounded by the capacity, not by the table
    found = (numbered.join(offsets, ["length", "bucket"]).join(F.broadcast(spots), "length")
             .withColumn("no", F.col("base") + F.col("at"))
             .withColumn("s", F.filter("spots", lambda s: (s["lo"] <= F.col("no")) & (F.col("no") < s["hi"]))[0])
             .withColumn("in_group", F.col("no") - F.col("s.lo")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("s.first") + F.floor(F.col("in_group") / F.col("s.copies"))).cast("long").alias("sequence_id"),
                        (F.col("s.at_token") + F.col("in_group") % F.col("s.copies") * F.col("length")).cast("long").alias("offset"))
