"""Decontamination against brute force over all item-sized windows."""

import random
import re
from collections import Counter

import numpy as np

import pyarrow as pa

from tandem.llm import decontaminate
from tandem.llm.decontaminate import BITS, Benchmark, Index, contaminated, simhash
from tandem.llm.words import mix, split_words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def bag(w, k=5):
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items):
    out = {}
    for n, (d, t) in enumerate(docs):
        w = words_of(t)
        for i, it in items:
            x = words_of(it)
            if not x:
                continue
            b, hits = bag(x), []
            for s in range(len(w) - len(x) + 1):
                c = bag(w[s:s + len(x)], min(5, len(x)))
                lo = sum((b & c).values())
                if 100 * lo >= 75 * sum((b | c).values()):
                    hits.append((-lo / sum((b | c).values()), s))
            if hits:
                best = min(hits)
                out[n, i] = (d, i, len(hits), best[1], len(x), round(-best[0], 9))
    return sorted(out.values(), key=str)


def result(df):
    return sorted(((r.doc_id, r.item_id, r.n_windows, r.window_start, r.n_words, round(r.similarity, 9)) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want and result(contaminated(docs, items)) == want


def test_edited_passages_and_edges(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    passage = [[word() for _ in range(n)] for n in (20, 40, 40, 3, 5)]
    items = [(i, " ".join(p)) for i, p in enumerate(passage)] + [(9, None), (10, " "), (11, "x x x x x x x x x x")]
    docs = []
    for i in range(60):
        p = list(rnd.choice(passage))
        for _ in range(rnd.randint(0, 3)):
            p[rnd.randrange(len(p))] = word()
        docs.append((i, " ".join([word() for _ in range(rnd.randint(0, 50))] + p + [word() for _ in range(rnd.randint(0, 9))]).upper()))
    docs += [(100, None), (101, ""), (102, "x " * 300), (103, " ".join(passage[1] * 3)), (103, " ".join(passage[1])), (None, " ".join(passage[0]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as similarity")
    b = spark.createDataFrame(items + items[:1], "item_id long, text string").selectExpr("*", "3 as doc_id")
    want = brute(docs, items)
    assert result(contaminated(d, b)) == want
    assert result(contaminated(d, b, block_bytes=200)) == want        # the benchmark in blocks
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, mix(rng.integers(0, 1 << 62, 30, dtype=np.uint64))) for i in range(40)]
    for radius in (3, 12, 24):
        index = Index(items, radius)
        probes = np.array([index.prints[i % 40] ^ np.uint64(sum(1 << int(b) for b in rng.choice(BITS, rng.integers(0, radius + 3), False)))
                           for i in range(400)], np.uint64)
        far = np.bitwise_count(probes[:, None] ^ index.prints[None])
        for some in (np.arange(40), np.array([3, 7, 39])):
            got = list(index.near(probes, some))
            assert {(w, i) for w, i, _ in got} == {(w, i) for w, i in zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True) if i in some}
            assert all(far[w, i] == d for w, i, d in got) and len(got) == len({x[:2] for x in got})
    assert simhash(items[0][1]) == index.prints[0]


def brute_short(docs, items):
    """Documents of fewer words than the item, compared whole."""
    out = []
    for d, t in docs:
        w = words_of(t)
        for i, it in items:
            x = words_of(it)
            kk = min(5, len(x))
            if kk <= len(w) < len(x):
                b, c = bag(x, kk), bag(w, kk)
                lo, hi = sum((b & c).values()), sum((b | c).values())
                if 100 * lo >= 75 * hi:
                    out.append((d, i, 1, 0, len(x), round(lo / hi, 9)))
    return out


def test_documents_shorter_than_the_item(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    passage = [[word() for _ in range(n)] for n in (15, 38, 38, 59, 6, 3)]
    items = [(i, " ".join(p)) for i, p in enumerate(passage)] + [(20, "x " * 20), (21, " ".join(passage[0][:12]))]
    docs = [(1, " ".join(passage[0][:13])), (2, " ".join(passage[1][:34])), (3, " ".join(passage[2][:19] + passage[2][20:])),
            (4, " ".join(passage[3][5:]).upper()), (5, " ".join(passage[4][:5])), (6, " ".join(passage[5][:2])), (7, "x " * 17), (8, "x"),
            (9, None), (10, "")]
    for n in range(11, 80):
        p = list(rnd.choice(passage))
        a = rnd.randint(0, len(p) // 8)
        p = p[a:len(p) - rnd.randint(0, len(p) // 8)]
        if rnd.random() < 0.3:
            del p[rnd.randrange(len(p))]
        docs.append((n, " ".join(p)))
    got = result(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = sorted(brute(docs, items) + brute_short(docs, items), key=str)
    assert got == want and {(1, 0), (2, 1), (3, 2), (4, 3), (7, 20)} <= {r[:2] for r in want}


def test_radius_loses_next_to_no_pair():
    """Windows at the lowest similarity of 0.75 or more, by the number of shingles."""
    rng = np.random.default_rng(3)
    for n in (11, 26, 55):
        shared = -(-6 * n // 7)                     # shared / (2n - shared) >= 0.75
        lost = 0
        for _ in range(8):
            signs = [(rng.integers(0, 2, (2500, k, BITS), dtype=np.int8) * 2 - 1).sum(1, dtype=np.int32) for k in (shared, n - shared, n - shared)]
            lost += int((((signs[0] + signs[1] > 0) != (signs[0] + signs[2] > 0)).sum(1) > 24).sum())
        assert lost <= 2, (n, lost)                 # of 20,000


def test_only_items_that_share_a_shingle_are_looked_up(monkeypatch):
    """Few pairs of a large benchmark are compared, and the size of a lookup changes nothing."""
    rnd = random.Random(4)
    line = lambda n: " ".join(str(rnd.randrange(5000)) for _ in range(n))
    items = [(i, f"what is the name of this {line(14)}") for i in range(50)] + [(i, line(20)) for i in range(50, 2000)]
    text = " ".join([line(300), items[7][1], line(100), items[1500][1], line(200), "what is the name of this", line(300)])
    bench, looked = Benchmark(items, 5, 24, 75), []
    near = Index.near

    def spy(self, prints, some):
        looked.append(len(prints) * len(some))
        return near(self, prints, some)

    monkeypatch.setattr(Index, "near", spy)
    words = split_words(pa.array([text], pa.large_string()), lower=True)
    want = list(bench.scan(words))
    assert [x[1] for x in want] == [7, 1500] and 0 < sum(looked) < 16 * 3 * 50 * 4
    monkeypatch.setattr(decontaminate, "PLACES", 3)
    assert list(bench.scan(words)) == want
