"""Word, shingle and line hashing against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm.arrow import small_slices
from tandem.llm.lines import document_keys, split_lines
from tandem.llm.words import grams, shingles, split_words

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÉß \t\n\x0b\x0c\r\x1fz"), max_size=30)), max_size=6)
WS = " \t\n\r\x0b\x0c"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t, lower):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD) if lower else (t or ""))


@settings(max_examples=80, deadline=None)
@given(TEXT, st.booleans())
def test_words_and_grams(texts, lower):
    w = split_words(pa.array(texts, pa.string()), lower)
    seen = {}
    for d, t in enumerate(texts):
        want = words_of(t, lower)
        got = range(w.first[d], w.first[d + 1])
        assert len(got) == len(want)
        for i, x in zip(got, want, strict=True):
            assert w.raw[w.start[i]:w.end[i]].tobytes().decode().translate(FOLD if lower else {}) == x
            assert seen.setdefault(int(w.hash[i]), x) == x
    assert len(set(seen.values())) == len(seen)
    s, at = shingles(w, 3)
    by_hash = {}
    for d, t in enumerate(texts):
        x = words_of(t, lower)
        want = [tuple(x[i:i + 3]) for i in range(max(1, len(x) - 2))] if x else []
        assert at[d + 1] - at[d] == len(want)
        for h, g in zip(s[at[d]:at[d + 1]].tolist(), want, strict=True):
            assert by_hash.setdefault(h, g) == g
    assert len(set(by_hash.values())) == len(by_hash)
    g, ok = grams(w, 2)
    assert ok.sum() == sum(max(0, len(words_of(t, lower)) - 1) for t in texts)


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_lines(texts):
    x = split_lines(pa.array(texts, pa.string()))
    seen = {}
    for d, t in enumerate(texts):
        want = (t or "").split("\n")
        got = [x.raw[x.start[i]:x.end[i]].tobytes().decode() for i in range(x.first[d], x.first[d + 1])]
        assert got == want
        for i, line in zip(range(x.first[d], x.first[d + 1]), want, strict=True):
            k = line.strip(WS).translate(FOLD)
            assert x.chars[i] == len(k)
            assert seen.setdefault(tuple(x.key[i].tolist()), k) == k
        keys = [line.strip(WS).translate(FOLD) for line in want]
        firsts = {keys.index(k) for k in set(keys) if len(k) >= 1}
        mine = document_keys(x, 1)
        assert {int(i - x.first[d]) for i in mine if x.first[d] <= i < x.first[d + 1]} == firsts
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows_and_are_small():
    b = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i % 7 * 100) for i in range(49)] + [None])], names=["i", "t"])
    parts = list(small_slices(iter([b, b.slice(0, 0)]), 1, 1000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in parts)
    assert np.concatenate([split_words(p.column(1), True).hash for p in parts]).size == 42
