"""MinHash near-duplicates against brute force, and the component search."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm.components import components
from tandem.llm.near_dup import _common_counts, _left_out, _max_xor, near_duplicates, shingle_sets, sketch_batch

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    """doc_id -> (n, component, kept) with unique ids, by an inverted index."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter((a, b) for ds in holders.values() for i, b in enumerate(ds) for a in ds[:i])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_copies_chains_and_edges(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]                       # a hot group of copies
    for i in range(60):                                                    # near copies, some of them too far
        t = list(base)
        for _ in range(rnd.randint(1, 7)):
            t[rnd.randrange(len(t))] = word()
        rows.append((100 + i, " ".join(t)))
    t = [word() for _ in range(80)]
    for i in range(12):                                                    # a chain whose ends are far apart
        rows.append((300 - i, " ".join(t)))
        t = t[:i * 6] + [word()] + t[i * 6 + 1:]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "One\ttwo"), (405, "two one"), (406, "É x"), (407, "é x")]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == brute(rows)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (3, "A b c d e f", 3), (3, "A b c d e f", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumnRenamed("text", "body") \
        .selectExpr("*", "1 as rep", "2 as n", "array(1) as bands", "'x' as text")
    got = sorted(near_duplicates(df, text="body").collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [("None", 2, "None", True), ("5", 2, "3", False), ("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True)])
    assert near_duplicates(df.limit(0), text="body").count() == 0


def test_repeated_ids_are_one_node(spark):
    """Ids with several texts join the groups of their texts; every row of an id has one component."""
    p, q, z = "a b c d e f g", "u v w x y z q", "k l m n o p r s"
    rows = [(2, p), (1, q), (2, q), (3, p), (9, z), (9, None), (4, z), (10, ""), (11, z + " t"), (11, "other words of its own here"), (12, "other words of its own here"),
            (20, "lone text with six words"), (20, " "), (None, p)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert seen == {2: {(1, False)}, 1: {(1, True)}, 3: {(1, False)}, 9: {(4, False)}, 4: {(4, True)}, 10: {(10, True)},
                    11: {(4, False)}, 12: {(4, False)}, 20: {(20, True)}, None: {(None, True)}}


def test_a_left_out_pair_is_found(spark):
    """Documents that meet only in a bucket whose centre is far from both."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(200))
    texts = [text, text + " x", " ".join(f"v{i}" for i in range(200))]
    size, s1, s2, keys, words = sketch_batch(pa.array(texts), 5, 32, 4, 512)
    reps = spark.createDataFrame([(i, int(size[i]), words[i].view(np.int64).tolist()) for i in range(3)], "rep long, n long, sketch array<long>")
    member = spark.createDataFrame([(7, 0, 3, 2), (7, 1, 3, 2), (7, 2, 3, 2)], "key long, r long, size long, c long")
    sets = shingle_sets(spark.createDataFrame([(i, texts[i], int(s1.view(np.int64)[i]), int(s2.view(np.int64)[i])) for i in range(3)],
                                              "rep long, text string, s1 long, s2 long"), 5)
    none = spark.createDataFrame([], "node long, component long")
    worst = _max_xor(128, 512, 0.75, 5.0)
    assert [tuple(r) for r in _left_out(member, reps, sets, none, worst, 75).collect()] == [(0, 1)]
    big = member.withColumn("size", F.lit(5000))        # the same bucket dealt in blocks
    assert [tuple(r) for r in _left_out(big, reps, sets, none, worst, 75).collect()] == [(0, 1)]


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(30)]
    got = _common_counts(sets, columns=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)
    assert _common_counts([]).shape == (0, 0)


@pytest.mark.parametrize("similarity", [0.75, 0.85, 0.95])
def test_sketch_estimate_and_bound(similarity):
    texts, n = [], 300
    for i in range(40):
        shared = int(round(n * 2 * similarity / (1 + similarity)))
        common = [f"c{i}_{j}" for j in range(shared)]
        texts += [" ".join(common + [f"{s}{i}_{j}" for j in range(n - shared)]) for s in "ab"]
    size, _, _, keys, words = sketch_batch(pa.array(texts), 1, 32, 4, 512)
    far = np.bitwise_count(words[::2] ^ words[1::2]).sum(1)
    assert (far <= _max_xor(128, 512, 0.75, 5.0)).all()
    estimate = 1 + 512 / (4 * 128) * np.log(1 - 2 * far / 512)
    assert abs(estimate.mean() - similarity) < 0.03
    assert (keys[::2] == keys[1::2]).any(1).all()


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(3, 3), (None, 4), (5, None)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
