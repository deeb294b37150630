"""Packing: round trip of the tokens, exact cutting, and the packer against one piece at a time."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tandem.llm.packing import _best_fit, cut_pieces, default_tokenizer, load_encoder, pack, pack_histogram, reduce_dominated

ENCODE = load_encoder(default_tokenizer())
TOKENIZER = Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("aZ1' \n\t 　é😀'slĺ<|>"), max_size=40)))
def test_ids_are_the_tokenizers(text):
    assert ENCODE(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_token_text():
    t = "a<|endoftext|> b"
    assert ENCODE(t) == TOKENIZER.encode(t, add_special_tokens=False).ids


def check(rows, got, capacity=2048):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {d: ids_of(t) for d, t in rows}
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for i, r in enumerate(pieces):
            part = np.array(want[d][at:at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(part))
            assert r.length == capacity or i == 0
            at += r.length
        assert at == len(want[d]) and (len(pieces) == 1) == (at <= capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    n = check(rows, pack(docs, bucket_rows=50).collect())
    total = sum(len(ids_of(t)) for _, t in rows)
    assert n <= 1.02 * total / 2048 + 1


def test_nulls_repeats_long_clashes_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "x " * 9000), (4, "hello world"), (5, "y" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length", "8 as bucket", "9 as piece")
    check(rows, pack(df).collect())
    twice = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")] * 2, "doc_id long, text string")
    got = pack(twice).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert pack(df.limit(0)).count() == 0


def test_cut_pieces():
    assert cut_pieces([0] * 5, 5) == [(0, 5)]
    assert cut_pieces([0] * 11, 5) == [(0, 1), (1, 5), (6, 5)]
    assert cut_pieces([0] * 10, 5) == [(0, 5), (5, 5)]


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        ok = [i for i, r in enumerate(rooms) if r >= n]
        if ok:
            rooms[min(ok, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def instances(seed, n):
    rnd = random.Random(seed)
    for i in range(n):
        capacity = rnd.choice([10, 23, 30, 100])
        low = rnd.choice([1, capacity // 5, capacity // 4, capacity // 3 + 1])
        yield capacity, [rnd.randint(low, capacity) for _ in range(rnd.randint(0, 60 if i % 3 == 0 else 9))]


def test_every_piece_is_packed_no_worse_than_best_fit():
    for capacity, lengths in instances(2, 400):
        count = {x: lengths.count(x) for x in lengths}
        bins = pack_histogram(count, capacity)
        used = {}
        for many, items in bins:
            assert sum(x * c for x, c in items) <= capacity
            for x, c in items:
                used[x] = used.get(x, 0) + many * c
        assert used == count
        fixed, left = reduce_dominated(count, capacity)
        rest = [x for x, c in left.items() for _ in range(c)]
        total = sum(m for m, _ in bins)
        assert total <= sum(m for m, _ in fixed) + best_fit(rest, capacity)
        assert sum(m for m, _ in _best_fit(left, capacity)) == best_fit(rest, capacity)
        if len(lengths) < 9:
            assert optimum(lengths, capacity) <= total <= optimum(lengths, capacity) + 1


def test_fixed_bins_keep_the_optimum():
    """Against an exact packer: the fixed bins and an optimum of the rest are an optimum of the whole."""
    fixed_any = triples = 0
    for capacity, lengths in instances(5, 1500):
        lengths = lengths[:8]
        fixed, left = reduce_dominated({x: lengths.count(x) for x in lengths}, capacity)
        rest = [x for x, c in left.items() for _ in range(c)]
        assert sum(m for m, _ in fixed) + optimum(rest, capacity) == optimum(lengths, capacity), (capacity, lengths)
        fixed_any += bool(fixed)
        triples += any(sum(c for _, c in items) == 3 for _, items in fixed)
    assert fixed_any > 1000 and triples > 20


def test_a_pair_is_not_fixed_where_three_fit():
    assert sum(m for m, _ in pack_histogram({10: 2, 4: 6}, 23)) == 2
    assert reduce_dominated({10: 2, 4: 6}, 23) == ([], {10: 2, 4: 6})
    assert sum(m for m, _ in pack_histogram({10: 2000, 4: 6000}, 23)) == 2000


def test_dominance_alone_is_optimal():
    """Instances that the reduction solves by itself are solved exactly."""
    rnd = random.Random(4)
    for _ in range(100):
        lengths = [rnd.randint(34, 100) for _ in range(8)]     # at most two a bin
        bins = pack_histogram({x: lengths.count(x) for x in lengths}, 100)
        assert sum(m for m, _ in bins) == optimum(lengths, 100)
