"""Estimation error of a mean difference against the number of samples.

For every (group, iteration) the rows are put in one random order (a keyed hash per
row and iteration); the sample of size n is the first n rows of that order, so the
samples of one iteration are nested prefixes (as pandas draws with one
``random_state`` are). The error at n is |full mean - prefix mean|.

Prefix sums need each row's rank inside (group, iteration): a two-level prefix scan, the same for
every group size. Rows are sorted by group and units once and packed into chunks: a 31-bit seed and its values, a few bytes a row.
The chunks of a group go to one cell per block of iterations (a fixed number of copies), where the draw hashes are
computed and ordered, so that a (row, iteration) pair is never shuffled. A group of more than ``BUCKET_ROWS`` rows is cut into
buckets of its hash range: level one counts and sums the rows of every (group, iteration, bucket) but the last; running
totals over the buckets are the offsets from which a cell of level two, (group, block, bucket), goes on. A group of more
than ``HELD_ROWS`` rows gets smaller blocks, so that no cell holds more rows than that on average. Cells whose rows have few different
tuples of values (differences of scores have) order 32-bit keys that bring the values along; others order 64-bit keys and look values up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.hashing import (MIX_P, mix_np, mix_premixed_np, poisson_weight_np, premixed_np, row_seed, row_seed_py,
                                      unmix_np)
from tandem.operators.indexing import _null_safe_join
from tandem.session import write_once

# ---- fixed values of the reference's error study -------------------------------------
ITERATIONS = 1000
STEP = 20
BUCKET_ROWS = 1 << 24  # rows of a group's bucket, on average
BLOCKS = 4             # blocks that a group's iterations are cut into, at least
CELL_PAIRS = 1 << 31   # (row, iteration) pairs that one cell orders, on average
HELD_ROWS = 1 << 25    # rows that one cell holds, on average
LONG_CELL = 1 << 24    # (row, iteration) pairs of a cell that takes longer than an empty task
MOST_PARTS = 4096      # partitions of the cells
CACHED = 1 << 18       # pairs ordered at once inside a cell
PART = 2048            # sample sizes of a piece of packed errors
CODES = 256            # different rows of values, at most, in a cell that orders 32-bit keys
CODED_ROWS = 1 << 14   # rows of such a cell, at least
TIES = 1 << 30         # rows of such a cell times 4 to the power of the hash bits that its keys leave out, at most


def reference_means(wide: DataFrame, values: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """A10 + P10: full-sample mean of each value column per group, and the group size."""
    return wide.groupBy(*groups).agg(F.count(F.lit(1)).cast("bigint").alias("n_total"),
                                     *[F.avg(v).alias(f"ref_{v}") for v in values],
                                     *[F.sum(v).alias(f"sum_{v}") for v in values])


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes: integers by the narrowest type that holds them all."""
    if x.dtype.kind == "i" and len(x):
        x = x.astype(np.result_type(np.min_scalar_type(min(int(x.min()), -1)), np.min_scalar_type(-1 - int(max(x.max(), 0)))))
    return x.tobytes()


def _widened(data: bytes, size: int, integral: bool = True) -> np.ndarray:
    """Inverse of :func:`_narrow` for ``size`` numbers."""
    return np.frombuffer(data, f"i{max(len(data) // max(size, 1), 1)}" if integral else np.float64)


def _pack(values: list[str], integral: bool):
    """Rows sorted by group and units -> chunks: (gid, seq, size) and row seeds and values as bytes."""
    kind = np.int64 if integral else np.float64

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            gid, at, r = (batch.column(c).to_numpy() for c in ("gid", "at", "r"))
            vals = [batch.column(v).to_numpy(zero_copy_only=False).astype(kind) for v in values]
            lo = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
            spans = list(zip(lo, np.append(lo[1:], len(gid))))
            yield pa.RecordBatch.from_pydict({
                "gid": gid[lo], "seq": at[lo], "size": np.array([b - a for a, b in spans], np.int64),
                "r": pa.array([r[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                **{v: pa.array([_narrow(x[a:b]) for a, b in spans], pa.binary()) for v, x in zip(values, vals)}})

    return run


def _chunks(batch: pa.RecordBatch, values: list[str], integral: bool) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(row of the batch, row seeds, values) of every chunk."""
    for i, size in enumerate(batch.column("size").to_pylist()):
        yield i, np.frombuffer(batch.column("r")[i].as_py(), np.int32), \
            [_widened(batch.column(v)[i].as_py(), size, integral) for v in values]


def _deal(values: list[str], iterations: int, integral: bool):
    """Level two, map side: the rows of a chunk once for each (block, bucket) that some iteration puts them in."""

    def run(batches):
        for batch in batches:
            ks, itss, gids, seqs = (batch.column(c).to_pylist() for c in ("n_buckets", "block_its", "gid", "seq"))
            for i, r, vals in _chunks(batch, values, integral):
                k, its = ks[i], itss[i]
                for blk in range(-(-iterations // its)):
                    if k == 1:          # one bucket: its number is 0 whatever the hash
                        picks = [(0, slice(None))]
                    else:
                        draw = np.arange(blk * its, min((blk + 1) * its, iterations))
                        seen = np.zeros((k, len(r)), bool)
                        for d in range(0, len(draw), 16):
                            seen[mix_np(r[None, :], draw[d:d + 16, None]) * k // MIX_P, np.arange(len(r))[None, :]] = True
                        picks = [(b, seen[b]) for b in np.flatnonzero(seen.any(axis=1))]
                    yield pa.RecordBatch.from_pydict({
                        "gid": np.full(len(picks), gids[i]), "blk": np.full(len(picks), blk, np.int32),
                        "bucket": np.array([b for b, _ in picks], np.int64), "seq": np.full(len(picks), seqs[i]),
                        "size": np.array([len(r[at]) for _, at in picks], np.int64),
                        "r": pa.array([r[at].astype(np.int32).tobytes() for _, at in picks], pa.binary()),
                        **{v: pa.array([x[at].tobytes() for _, at in picks], pa.binary()) for v, x in zip(values, vals)}})

    return run


def _bucket_totals(values: list[str], iterations: int, integral: bool):
    """Level one, map side: rows and value sums of every (group, iteration, bucket) of a chunk, without the last bucket."""
    kind = np.int64 if integral else np.float64
    per_slice = 16

    def run(batches):
        for batch in batches:
            ks, itss, gids = (batch.column(c).to_pylist() for c in ("n_buckets", "block_its", "gid"))
            for i, r, vals in _chunks(batch, values, integral):
                k = ks[i]
                for lo in range(0, iterations, per_slice):
                    draw = np.arange(lo, min(lo + per_slice, iterations))
                    bucket = mix_np(r[None, :], draw[:, None]) * k // MIX_P
                    keep = bucket < k - 1
                    code = ((draw - lo)[:, None] * k + bucket)[keep]
                    cell, inv, cnt = np.unique(code, return_inverse=True, return_counts=True)
                    out = {"gid": np.full(len(cell), gids[i]), "iter": (cell // k + lo).astype(np.int32),
                           "block_its": np.full(len(cell), itss[i]), "bucket": cell % k, "cnt": cnt.astype(np.int64)}
                    for v, x in zip(values, vals):
                        out[f"s_{v}"] = np.zeros(len(cell), kind)
                        np.add.at(out[f"s_{v}"], inv, np.broadcast_to(x.astype(kind)[None, :], keep.shape)[keep])
                    yield pa.RecordBatch.from_pydict(out)

    return run


class _Ranked:
    """Sample sizes and prefix sums that a cell's rows reach, for a few iterations: from the offsets on."""

    def __init__(self, r: np.ndarray, draw: np.ndarray, bucket: int, k: int, before: np.ndarray, step: int, n_total: int):
        bits = max(1, (len(r) - 1).bit_length())
        flat, count = [], np.zeros(len(draw), np.int64)
        for lo in range(0, len(r), CACHED):          # slices that stay in the processor's cache
            some = r[lo:lo + CACHED]
            h = mix_np(some[None, :], draw[:, None])
            key = h << bits
            key |= np.arange(lo, lo + len(some))
            key |= np.arange(len(draw))[:, None] << (bits + 31)
            if k > 1:
                here = h * k // MIX_P == bucket
                count += here.sum(1)
                flat.append(key[here])
            else:
                count += len(some)
                flat.append(key.ravel())
        flat = np.concatenate(flat) if len(flat) > 1 else flat[0]
        flat.sort()
        flat &= (1 << bits) - 1
        self.row = flat
        self.start = np.cumsum(count) - count
        self.end = self.start + count
        last = np.minimum(before + count, n_total - 1)
        some = np.maximum(last // step - before // step, 0)
        self.seg = np.repeat(np.arange(len(draw)), some)
        nth = np.arange(len(self.seg)) - np.repeat(np.cumsum(some) - some, some) + 1
        self.n = (before // step)[self.seg] * step + nth * step
        self.at = self.start[self.seg] + self.n - before[self.seg] - 1

    def prefix(self, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        if value.dtype.kind == "i":          # differences of wrapped sums are exact
            run = np.cumsum(value[self.row], dtype=np.int64)
            first = self.start[self.seg]
            return run[self.at] - np.where(first > 0, run[first - 1], 0) + before[self.seg]
        run = np.concatenate([np.cumsum(value[self.row[a:b]]) for a, b in zip(self.start, self.end)] or [np.zeros(0)])
        return run[self.at] + before[self.seg]


class _Coded:
    """Rows of a cell whose values are few different tuples, ordered by 32-bit keys: the upper bits of the draw hash and the
    number of the tuple below them, so that a key brings its values along.

    The hash bits left out, and rows of one hash, are ties, which matter where a sample size cuts a group of them whose tuples differ.
    The rows of such a group are found by their seeds (the hash is inverted) and put in their true order."""

    def __init__(self, r: np.ndarray, codes: np.ndarray, tables: list[np.ndarray], step: int, k: int, n_total: int):
        self.rank = np.argsort(r, kind="stable")           # the rows come in order of units
        self.r, self.codes = r[self.rank], codes[self.rank]
        self.seed, self.wide = premixed_np(self.r), self.codes.astype(np.uint32)
        self.tables, self.step, self.k, self.n_total = tables, step, k, n_total
        # differences from the lowest value as a byte for each code, where a block of ``step`` of them is a byte again
        fits = [step % 4 == 0 and (int(t.max()) - int(t.min())) * step <= 255 for t in tables]
        self.bytes = [np.pad(t - t.min(), (0, 256 - len(t))).astype(np.uint8).tobytes() if f else None for t, f in zip(tables, fits)]
        self.bits = max(len(tables[0]) - 1, 0).bit_length()
        self.cut = max(self.bits - 1, 0)                    # hash bits that find no place

    @classmethod
    def of(cls, r: np.ndarray, vals: list[np.ndarray], step: int, k: int, n_total: int) -> _Coded | None:
        """None if the tuples are too many, or the ties."""
        at, base, size = np.zeros(len(r), np.int64), [], 1
        for x in vals:
            low, high = int(x.min()), int(x.max())
            base.append((low, size, high - low + 1))
            size *= high - low + 1
            if size > 1 << 16:
                return None
            at += (x.astype(np.int64) - low) * base[-1][1]
        used = np.flatnonzero(np.bincount(at, minlength=size))
        if len(used) > CODES or len(r) << 2 * max(max(len(used) - 1, 0).bit_length() - 1, 0) > TIES:
            return None
        number = np.zeros(size, np.uint8)
        number[used] = np.arange(len(used))
        return cls(r, number[at], [used // by % wide + low for low, by, wide in base], step, k, n_total)

    def prefixes(self, draw: int, bucket: int, before: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """Sample sizes that the rows of one draw reach from ``before`` rows on, and the sums of every value up to them; None if
        a tie cannot be resolved."""
        h = mix_premixed_np(self.seed, draw, np.empty(len(self.seed), np.uint32))
        key = h >> np.uint32(self.cut)
        key <<= np.uint32(self.bits)
        key |= self.wide
        if self.k > 1:
            key = key[h.astype(np.int64) * self.k // MIX_P == bucket]
        del h
        key.sort()
        step = self.step
        some = max(min(before + len(key), self.n_total - 1) // step - before // step, 0)
        n = (before // step + 1 + np.arange(some)) * step
        at = n - before - 1
        if not some:
            return n, [np.zeros(0, np.int64) for _ in self.tables]
        low = np.uint32((1 << self.bits) - 1)
        codes = key[:at[-1] + 1].astype(np.uint8)
        codes &= np.uint8(low)
        sums = [_sums_to(codes, t, b, int(at[0]) + 1, step) for t, b in zip(self.tables, self.bytes)]
        inner = at[at + 1 < len(key)]
        tied = np.flatnonzero(key[inner] >> self.bits == key[inner + 1] >> self.bits)
        if len(tied):
            last = inner[tied]
            group = key[last] >> self.bits << self.bits
            left, right = np.searchsorted(key, group, "left"), np.searchsorted(key, group | low, "right")
            mixed = key[left] != key[right - 1]
            tied, last, left, right, group = (x[mixed] for x in (tied, last, left, right, group))
        if len(tied):
            rows = self._members(group >> np.uint32(self.bits), right - left, draw, bucket)
            if rows is None:
                return None
            size = right - left
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            taken = nth <= np.repeat(last - left, size)
            was = (key[np.repeat(left, size) + nth] & low)[taken]
            of, now = np.repeat(tied, size)[taken], self.codes[rows][taken]
            for x, t in zip(sums, self.tables):
                np.add.at(x, of, t[now] - t[was])
        return n, sums

    def _members(self, group: np.ndarray, size: np.ndarray, draw: int, bucket: int) -> np.ndarray | None:
        """Rows of the given upper hash bits, group after group in true order; None if not ``size`` are found."""
        h = ((group.astype(np.int64) << self.cut)[:, None] + np.arange(1 << self.cut)).ravel()
        owner = np.repeat(np.arange(len(group)), 1 << self.cut)
        valid = (h < MIX_P) & (h * self.k // MIX_P == bucket)
        h, owner = h[valid], owner[valid]
        r = unmix_np(h, draw).astype(np.int32)
        first, last = np.searchsorted(self.r, r, "left"), np.searchsorted(self.r, r, "right")
        count = last - first
        rows = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, h = np.repeat(owner, count), np.repeat(h, count)
        if (np.bincount(owner, minlength=len(group)) != size).any():
            return None
        return rows[np.lexsort((self.rank[rows], h, owner))]


def _sums_to(codes: np.ndarray, table: np.ndarray, as_bytes: bytes | None, first: int, step: int) -> np.ndarray:
    """Sums of ``table[codes]`` over the first ``first``, ``first + step``, ... codes, all of them last."""
    if as_bytes is None:
        return np.cumsum(table[codes])[first - 1::step]
    # four sums side by side in the bytes of a word, then one
    data = codes.tobytes().translate(as_bytes)
    words = np.frombuffer(data, np.uint32, (len(data) - first) // 4, first) if first % 4 == 0 else np.frombuffer(data[first:], np.uint32)
    words = words.reshape(-1, step // 4)
    block = np.zeros(len(words) + 1, np.uint32)
    for i in range(step // 4):
        block[1:] += words[:, i]
    block *= np.uint32(0x01010101)
    block >>= np.uint32(24)
    block[0] = np.frombuffer(data, np.uint8, first).sum()
    return np.cumsum(block, dtype=np.int64) + (first + np.arange(len(block)) * step) * int(table.min())


def _numerators(total: int, p: np.ndarray, n: np.ndarray, n_total: int) -> np.ndarray:
    """``|S n - p N|``, exact: in 64 bits where they hold it, else in Python integers."""
    if max(abs(total), int(np.abs(p).max(initial=0))) * n_total >= 1 << 62:
        p, n = p.astype(object), n.astype(object)
    return np.abs(total * n - p * n_total)


def _add_at(out: np.ndarray, at: slice | np.ndarray, x: np.ndarray) -> None:
    if isinstance(at, slice):
        out[at] += x
    else:
        np.add.at(out, at, x)


def _squeezed(data: bytes, size: int) -> bytes:
    """``size`` integers compressed, behind a byte for their width."""
    return bytes([(len(data) // size).bit_length() - 1]) + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unsqueezed(data: bytes, size: int) -> np.ndarray:
    """Inverse of :func:`_squeezed`."""
    return _widened(pa.Codec("zstd").decompress(data[1:], size << data[0], asbytes=True), size)


def _packed(seg: np.ndarray, n: np.ndarray, prefix: np.ndarray, step: int, size: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Prefix sums cut by iteration and range of ``size`` sample sizes: (slice, part, first n, size, first sum, differences)."""
    part = (n // step - 1) // size
    lo = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (part[1:] != part[:-1])))
    for a, b in zip(lo, np.append(lo[1:], len(part))):
        p = prefix[a:b]
        yield int(seg[a]), int(part[a]), int(n[a]), int(b - a), int(p[0]), _squeezed(_narrow(np.diff(p, prepend=p[:1])), int(b - a))


def _cells(values: list[str], iterations: int, step: int, form: str, integral: bool, with_numerators: bool,
           out_names: list[str], part: int):
    """Level two: a partition's cells one after the other, each a header and its chunks; rows ordered by (draw hash,
    units) for each iteration of the block.

    Gives one row per iteration and n (``rows``); one per n, with the numerators ``|S n - p N|`` summed over
    the iterations as ``hi * 2^32 + lo`` (``mean``); or the prefix sums packed (``packed``)."""
    kind = np.int64 if integral else np.float64

    def one(head: dict, chunks: list[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        gid, blk, bucket, k, its, n_total = (head[c] for c in ("gid", "blk", "bucket", "n_buckets", "block_its", "n_total"))
        draws = np.arange(blk * its, min((blk + 1) * its, iterations))
        before = {c: np.zeros(len(draws), kind if c != "cnt" else np.int64) for c in ["cnt", *[f"s_{v}" for v in values]]}
        for shift in head["before"] or ():
            for c, x in before.items():
                x[shift["iter"] - draws[0]] = shift[c]
        if not chunks:
            return
        r = np.concatenate([c[0] for c in chunks])
        vals = {v: np.concatenate([c[1][i] for c in chunks]) for i, v in enumerate(values)}
        chunks.clear()
        low = int(before["cnt"].min()) // step
        sizes = (min(int(before["cnt"].max()) + len(r), n_total - 1)) // step - low
        seen = np.zeros(max(sizes, 0), np.int64)
        sums = {v: (np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)) for v in values}
        few = max(1, min(CACHED // max(len(r), 1), 1 << 10))
        coded = _Coded.of(r, list(vals.values()), step, k, n_total) if integral and len(r) >= CODED_ROWS else None

        def reached(some: slice) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            """Number of the draw, sample sizes and prefix sums of every value that some draws reach."""
            found = [coded.prefixes(int(d), bucket, int(b)) for d, b in zip(draws[some], before["cnt"][some])] if coded else [None]
            if any(f is None for f in found):
                got = _Ranked(r, draws[some], bucket, k, before["cnt"][some], step, n_total)
                return got.seg, got.n, [got.prefix(x, before[f"s_{v}"][some]) for v, x in vals.items()]
            seg = np.repeat(np.arange(len(found)), [len(n) for n, _ in found])
            n, *sums = (found[0][0], *found[0][1]) if len(found) == 1 else map(np.concatenate, zip(*[(n, *p) for n, p in found]))
            return seg, n, [p + before[f"s_{v}"][some][seg] for v, p in zip(values, sums)]

        for a in range(0, len(draws), few):
            some = slice(a, a + few)
            seg, n, prefixes = reached(some)
            if not len(n):
                continue
            cols = {}
            if form == "mean":
                slot = n // step - low - 1
                if seg[-1] == seg[0]:           # one draw: neighbouring sizes
                    slot = slice(int(slot[0]), int(slot[-1]) + 1)
                _add_at(seen, slot, np.ones(len(n), np.int64))
            elif form == "rows":
                cols = {"gid": np.full(len(n), gid), "iter": draws[some][seg].astype(np.int32), "n": n}
                den = n.astype(np.float64) * n_total
            for v, p in zip(values, prefixes):
                total = head[f"s_{v}"]
                if form == "packed":
                    pieces = list(_packed(seg, n, p, step, part))
                    at = [x[0] for x in pieces]
                    cols |= {"gid": np.full(len(at), gid), "iter": draws[some][at].astype(np.int32),
                             **{c: np.array([x[i] for x in pieces], np.int64) for c, i in (("part", 1), ("n_first", 2), ("size", 3), (f"base_{v}", 4))},
                             f"data_{v}": pa.array([x[5] for x in pieces], pa.binary())}
                    continue
                if not integral:
                    cols[f"err_{v}"] = np.abs(float(total) / n_total - p / n)
                    continue
                num = _numerators(int(total), p, n, n_total)
                if form == "mean":
                    _add_at(sums[v][0], slot, (num >> 32).astype(np.int64))
                    _add_at(sums[v][1], slot, (num & 0xFFFFFFFF).astype(np.int64))
                else:
                    cols[f"err_{v}"] = num.astype(np.float64) / den
                    if with_numerators:
                        cols[f"num_{v}"], cols["err_den"] = num.astype(np.float64), den
            if form != "mean":
                yield from pa.table({c: cols[c] for c in out_names}).to_batches(max_chunksize=1 << 16)
        if form == "mean":
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"gid": np.full(len(at), gid), "n": (at + low + 1) * step, "cnt": seen[at],
                                              **{f"{side}_{v}": sums[v][i][at] for v in values for i, side in enumerate(("hi", "lo"))}})

    def run(batches):
        head, chunks = None, []
        for batch in batches:
            seq = batch.column("seq").to_numpy()
            for i, r, vals in _chunks(batch, values, integral):
                if seq[i] < 0:
                    if head is not None:
                        yield from one(head, chunks)
                    head, chunks = batch.slice(i, 1).drop_columns(["r", *values]).to_pylist()[0], []
                else:
                    chunks.append((r, vals))
        if head is not None:
            yield from one(head, chunks)

    return run


def subsample_error(wide: DataFrame, values: Sequence[str], groups: Sequence[str], units: Sequence[str],
                    iterations: int = ITERATIONS, step: int = STEP, seed: int = 0,
                    bucket_rows: int = BUCKET_ROWS, reduce: bool = False, numerators: bool = True, packed: bool = False) -> DataFrame:
    """A11 + W3 + P16: error |mean - prefix mean| for n = step, 2 step, ... < N, per group
    and iteration, one ``err_<value>`` column per value column.

    The random order of iteration i sorts rows by mix(row seed, i) (ties by ``units``),
    where the row seed is md5 of (seed, groups, units): see :func:`tandem.functions.hashing.mix`.
    ``bucket_rows`` sets the number of buckets of a group, nothing else. With ``reduce`` (integer values) the mean error
    over the iterations is returned, per group and n: ``mean_<value>``, from exact sums. Integer values also give the
    errors' numerators and denominator unless ``numerators`` is false. A null group key is a group of its own.

    With ``packed`` (integer values) the same errors come as one row per group, iteration and range of sample sizes: ``part``, its
    first n and number of sizes, and per value a struct of the group's sum, the first prefix sum and the compressed differences
    of the others (about a byte a sample size). :func:`to_long` and :func:`error_curve` take that form."""
    groups, units, values = list(groups), list(units), list(values)
    # The input is read twice (group statistics, chunks): write its narrow projection once
    # (reliable checkpoint in the shared folder) instead of recomputing its upstream plan.
    wide = write_once(wide.select(*groups, *units, *values))
    integral = all(isinstance(wide.schema[v].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
                   for v in values)
    if (reduce or packed) and not integral:
        raise ValueError("reduce=True and packed=True need integer value columns")
    number, sums = ("long" if integral else "double"), [f"s_{v}" for v in values]
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_total") / F.lit(bucket_rows)))
    n, k = F.col("n_total"), F.col("n_buckets")
    block = F.least(F.lit(-(-iterations // BLOCKS)), F.floor(F.lit(CELL_PAIRS) * k / n))
    # a block of b iterations puts a row into a bucket with probability 1 - (1 - 1/k)^b
    held = F.floor(F.log(1 - F.lit(HELD_ROWS) / n) / F.log(1 - 1 / k))
    block = F.greatest(F.lit(1), F.when((n > HELD_ROWS) & (k > 1), F.least(block, held)).otherwise(block))
    # ids of a checkpointed table stay as they are
    stats = write_once(reference_means(wide, values, groups).withColumn("n_buckets", buckets.cast("long"))
                       .withColumn("block_its", block.cast("long")).withColumn("gid", F.monotonically_increasing_id()))
    blocks = F.ceil(F.lit(iterations) / F.col("block_its"))
    several = F.col("n_buckets") > 1
    cells, rows = (x or 0 for x in stats.agg(F.sum(blocks * k), F.sum(n)).first())
    x = _null_safe_join(wide, stats.select(*groups, "gid"), groups).select(
        "gid", *units, *values, row_seed(F.lit(seed), *[F.col(c) for c in groups + units]).alias("r"))
    # chunks of neighbouring rows; range bounds are sampled, so one layout is written
    ranged = x.repartitionByRange("gid", *units).sortWithinPartitions("gid", *units, *values) \
        .select("gid", "r", *values, F.monotonically_increasing_id().alias("at"))
    blobs = ", ".join(f"`{c}` binary" for c in ["r", *values])
    chunks = write_once(ranged.mapInArrow(_pack(values, integral), f"gid long, seq long, size long, {blobs}"))
    shaped = chunks.join(stats.select("gid", "n_buckets", "block_its"), "gid")
    dealt = shaped.mapInArrow(_deal(values, iterations, integral), f"gid long, blk int, bucket long, seq long, size long, {blobs}")

    # level one: totals of all buckets but the last, with a zero for each, so that no running total is missing
    schema = f"gid long, iter int, block_its long, bucket long, cnt long, {', '.join(f'`{c}` {number}' for c in sums)}"
    totals = shaped.where(several).mapInArrow(_bucket_totals(values, iterations, integral), schema)
    grid = stats.where(several).select("gid", "block_its", "n_buckets", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter")) \
        .select("gid", "iter", "block_its", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 2)).alias("bucket"),
                F.lit(0).cast("long").alias("cnt"), *[F.lit(0).cast(number).alias(c) for c in sums])
    per = totals.unionByName(grid).groupBy("gid", "iter", "block_its", "bucket").agg(*[F.sum(c).alias(c) for c in ["cnt", *sums]])
    running = Window.partitionBy("gid", "iter").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per.select("gid", "iter", (F.col("iter") / F.col("block_its")).cast("int").alias("blk"), (F.col("bucket") + 1).alias("bucket"),
                         *[F.sum(c).over(running).cast("long" if c == "cnt" else number).alias(c) for c in ["cnt", *sums]])
    # one entry per iteration of the block
    before = offsets.groupBy("gid", "blk", "bucket").agg(F.collect_list(F.struct("iter", "cnt", *sums)).alias("before"))
    header = stats.select("gid", "block_its", "n_buckets", "n_total", *[F.col(f"sum_{v}").cast(number).alias(f"s_{v}") for v in values],
                          F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("blk")) \
        .withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)))
    none = F.lit(b"")
    heads = header.join(before, ["gid", "blk", "bucket"], "left").withColumns(
        {"seq": F.lit(-1).cast("long"), "size": F.lit(0).cast("long"), **{c: none for c in ["r", *values]}})

    # level two
    key = ["gid", "blk", "bucket"]
    conf = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cells fall to tasks by a hash: long ones to more tasks, so that few meet
    spare = 8 * cells if rows * iterations > cells * LONG_CELL else 0
    parts = int(max(conf, min(2 * cells, MOST_PARTS), min(spare, 512)))
    if reduce:
        form, names = "mean", []
        schema = "gid long, n long, cnt long, " + ", ".join(f"`{s}_{v}` long" for v in values for s in ("hi", "lo"))
    elif packed:
        form, names = "packed", ["gid", "iter", "part", "n_first", "size", *[f"{c}_{v}" for v in values for c in ("base", "data")]]
        schema = "gid long, iter int, part long, n_first long, size long, " + ", ".join(f"`base_{v}` long, `data_{v}` binary" for v in values)
    else:
        form, numerators = "rows", numerators and integral
        names = ["gid", "iter", "n", *[f"err_{v}" for v in values]] + (["err_den", *[f"num_{v}" for v in values]] if numerators else [])
        schema = "gid long, iter int, n long, " + ", ".join(f"`{c}` double" for c in names[3:])
    found = dealt.unionByName(heads, allowMissingColumns=True).repartition(parts, *key).sortWithinPartitions(*key, "seq") \
        .mapInArrow(_cells(values, iterations, step, form, integral, numerators, names, PART), schema)
    named = stats.select("gid", *groups, "n_total", *[F.col(f"sum_{v}").alias(f"s_{v}") for v in values])
    if packed:
        return found.join(named, "gid").select(*groups, *names[1:5], "n_total", *[F.struct(
            F.col(f"s_{v}").alias("total"), F.col(f"base_{v}").alias("base"), F.col(f"data_{v}").alias("data")).alias(f"sums_{v}") for v in values])
    if not reduce:
        return found.join(named, "gid").select(*groups, *names[1:])
    tot = found.groupBy("gid", "n").agg(F.sum("cnt").alias("iterations"), *[
        (F.sum(F.col(f"hi_{v}").cast("decimal(20,0)")).cast("decimal(26,0)") * F.lit(1 << 32).cast("decimal(11,0)")
         + F.sum(f"lo_{v}").cast("decimal(20,0)")).cast("double").alias(f"num_{v}") for v in values])
    den = F.col("iterations").cast("double") * F.col("n") * F.col("n_total")
    return tot.join(named, "gid").select(*groups, "n", F.col("iterations").cast("bigint").alias("iterations"),
                                         *[(F.col(f"num_{v}") / den).alias(f"mean_{v}") for v in values])


def to_long(errors: DataFrame, keys: Sequence[str], value_names: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide ``err_<value>`` columns -> rows (keys, model_a, model_b, err[, num, den]); packed errors stay packed (``keys`` without
    ``iter`` and ``n``, which are inside)."""
    exact, packed = "err_den" in errors.columns, "n_first" in errors.columns
    if packed:
        keys = [*[k for k in keys if k not in ("iter", "n")], "iter", "part", "n_first", "size", "n_total"]

    def fields(v):
        if packed:
            return [F.col(f"sums_{v}")[c].alias(c) for c in ("total", "base", "data")]
        extra = [F.col(f"num_{v}").alias("num"), F.col("err_den").alias("den")] if exact else []
        return [F.col(f"err_{v}").alias("err"), *extra]

    arr = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), *fields(v))
                    for v, (a, b) in value_names.items()])
    return errors.select(*keys, F.explode(arr).alias("p")).select(*keys, "p.*")


def error_mean(errors_long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A12 (centre): mean error per (keys, n) over iterations (from exact integer
    numerators when the values are integers)."""
    cnt = F.count(F.lit(1)).cast("bigint")
    if "num" in errors_long.columns:
        mean = F.sum("num") / (cnt * F.first("den"))
    else:
        mean = F.avg("err")
    return errors_long.groupBy(*keys, "n").agg(cnt.alias("iterations"), mean.alias("mean_err"))


def _weights(draws: int, seed: int, iterations: int) -> np.ndarray:
    """Poisson weights, one row per draw and one column per iteration."""
    seeds = np.array([row_seed_py(seed, "boot", i) for i in range(iterations)], np.int64)
    return poisson_weight_np(seeds[None, :], np.arange(draws)[:, None]).astype(np.float64)


def _quantile(rows: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of every sorted row."""
    at = q * (rows.shape[1] - 1)
    low = min(int(at), rows.shape[1] - 1)
    high = min(low + 1, rows.shape[1] - 1)
    return rows[:, low] + (rows[:, high] - rows[:, low]) * (at - low)


def _bootstrap_packed(draws: int, seed: int, level: float, keys: list[str], iterations: int, step: int):
    """One range of sample sizes of one key: all its iterations unpacked, all its draws by one matrix product."""
    tails = [(1 - level) / 2, (1 + level) / 2]
    kept: list[np.ndarray] = []

    def run(table: pa.Table) -> pa.Table:
        if not kept:
            kept.append(_weights(draws, seed, iterations))
        its, firsts, sizes, bases, data = (table[c].to_pylist() for c in ("iter", "n_first", "size", "base", "data"))
        total, n_total = table["total"][0].as_py(), table["n_total"][0].as_py()
        low, high = min(firsts), max(f + (s - 1) * step for f, s in zip(firsts, sizes))
        n = np.arange(low, high + 1, step)
        x = np.zeros((iterations, len(n)))
        for it, first, size, base, d in zip(its, firsts, sizes, bases, data):
            a = (first - low) // step
            p = base + np.cumsum(_unsqueezed(d, size), dtype=np.int64)
            x[it, a:a + size] = _numerators(total, p, n[a:a + size], n_total).astype(np.float64)
        den = n.astype(np.float64) * n_total
        weight = kept[0][kept[0].sum(axis=1) > 0]
        means = (x.T @ weight.T) / (weight.sum(axis=1)[None, :] * den[:, None])
        means.sort(axis=1)          # faster than selecting in every row
        lo, hi = (_quantile(means, t) for t in tails)
        out = [pa.chunked_array([pa.repeat(table[k][0], len(n))]) for k in keys]
        return pa.table([*out, pa.array(n), pa.array(np.full(len(n), iterations)), pa.array(x.sum(axis=0) / (iterations * den)),
                         pa.array(lo), pa.array(hi)], names=[*keys, "n", "iterations", "mean_err", "ci_lo", "ci_hi"])

    return run


def _bootstrap_batches(draws: int, seed: int, level: float, keys: list[str], iterations: int):
    tails = [50 * (1 - level), 50 * (1 + level)]
    kept: list[np.ndarray] = []

    def run(batches):
        if not kept:
            kept.append(_weights(draws, seed, iterations))
        for batch in batches:
            stats = np.zeros((batch.num_rows, 4))
            for i, (xs, den) in enumerate(zip(batch.column("xs"), batch.column("den").to_numpy())):
                at, x = (xs.values.field(c).to_numpy() for c in ("iter", "x"))
                w = kept[0] if len(at) == iterations else kept[0][:, at]
                total = w.sum(axis=1)
                means = (w @ x)[total > 0] / (total[total > 0] * den)
                stats[i] = len(x), x.sum() / (len(x) * den), *np.percentile(means, tails)
            out = [batch.column(c) for c in [*keys, "n"]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(stats[:, 0].astype(np.int64)), *map(pa.array, stats[:, 1:].T)],
                                             names=[*keys, "n", "iterations", "mean_err", "ci_lo", "ci_hi"])

    return run


def error_curve(errors_long: DataFrame, keys: Sequence[str], draws: int = 1000, seed: int = 0,
                level: float = 0.95, iterations: int = ITERATIONS, step: int = STEP) -> DataFrame:
    """Mean error and ``level`` Poisson-bootstrap percentile interval per (keys, n).

    The weight of iteration i in draw d is the Poisson(1) quantile of a keyed uniform of (seed, i, d): the same for every
    key, engine and retry. A draw's mean is ``sum(w * error) / sum(w)`` (draws without weight are left out);
    percentiles interpolate linearly. Integer errors (``num`` over a common ``den``) are summed exactly.

    Each (keys, n) holds one value per iteration (bounded by the iteration count, not by the data), gathered
    into one array; the draws of a point are one product with the weight matrix. Packed errors (see :func:`subsample_error`; their
    ``step`` is needed) are gathered by range of sample sizes, and the draws of a range are one product."""
    keys = list(keys)
    result = T.StructType([f for f in errors_long.schema.fields if f.name in keys]
                          + [T.StructField("n", T.LongType()), T.StructField("iterations", T.LongType()), T.StructField("mean_err", T.DoubleType()),
                             T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType())])
    names = [f.name for f in result.fields[:len(keys)]]
    if "n_first" in errors_long.columns:
        return errors_long.groupBy(*names, "part").applyInArrow(_bootstrap_packed(draws, seed, level, names, iterations, step), result)
    exact = "num" in errors_long.columns
    x = F.col("num" if exact else "err").cast("double").alias("x")
    den = F.first("den") if exact else F.lit(1.0)
    arr = errors_long.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("iter", x))).alias("xs"),
                                              den.cast("double").alias("den"))
    return arr.select(*names, "n", "xs", "den").mapInArrow(_bootstrap_batches(draws, seed, level, names, iterations), result)


def samples_needed(curve: DataFrame, keys: Sequence[str], level: float | DataFrame) -> DataFrame:
    """Smallest n whose mean error is at most the level (NULL if none), per keys.

    ``level`` is one number for all keys, or a table of levels: ``level`` and any of the key columns. A table gives a
    row per key and level it names (several levels of one key are several rows); keys it does not name give none. Null keys match null keys."""
    first = F.min(F.when(F.col("mean_err") <= F.col("level"), F.col("n"))).alias("n_needed")
    if not isinstance(level, DataFrame):
        return curve.withColumn("level", F.lit(float(level))).groupBy(*keys).agg(first)
    on = [c for c in level.columns if c != "level"]
    wanted = level.select(*on, F.col("level").cast("double").alias("level")).distinct()
    return _null_safe_join(curve, wanted, on).groupBy(*keys, "level").agg(first)
