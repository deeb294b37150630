"""Hard negatives and exact top-k against brute force; their scoring and stopping rules."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import vectors
from tandem.llm.hard_negatives import bit_planes, hard_negatives, score_blocks, scores, subset_sums
from tandem.llm.top_k import SortedLists, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, key string"


def integers(rows):
    """Distinct usable rows: (id, integer vector, label)."""
    out = set()
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, every, k):
    rows = {(i, v) for i, v, _ in integers(rows)}
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-dot(q, v), j) for j, v in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every):
    rows = {r for r in integers(rows) if r[2] is not None}
    out = []
    for i, q, label in rows:
        if i % every:
            continue
        scored = sorted((-dot(q, v), j, lab) for j, v, lab in rows if j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:5]:
            found = [(s, j) for s, j, lab in scored if lab != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def sample(n=300, width=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) * 0.3
    rows = [(i, (centres[i % 4] + rng.normal(size=width) * 0.3).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[i][1], (rows[i][2] + i) % 4) for i in range(0, n, 3)]       # ties
    rows += rows[:40]                                                               # repeated rows
    rows += [(10, rows[7][1], 2), (2000, [], 1), (2010, [0.5], 1), (2020, None, 1), (2030, [1.0, None], 1),
             (2040, [float("nan")] * width, 1), (2050, [float("inf")] * width, 1), (None, rows[0][1], 1), (2060, rows[0][1], None),
             (2070, [0.0] * width, 0), (-20, rows[5][1], 1)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA).repartition(parts)


def test_lookup_scores_are_inner_products():
    rng = np.random.default_rng(3)
    for width, high in ((1, 1), (7, 5), (8, 300), (21, 70000)):
        a, r = rng.integers(-high, high + 1, (150, width)), rng.integers(-high, high + 1, (1100, width))
        r[0] = 0
        assert (scores(subset_sums(a[:5], np.int64), bit_planes(r)) == r @ a[:5].T).all()
        for part, got in score_blocks(a, r, width * high * high):
            assert (got == r @ a[part].T).all()
    only = np.array([[-256, -1, 0]])
    assert (scores(subset_sums(only, np.int64), bit_planes(only)) == only @ only.T).all()


@pytest.mark.parametrize("slices", [1, 4, 16])
def test_sorted_lists_stop_early_and_exactly(slices):
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-50, 51, (700, 6)), np.tile(rng.integers(-50, 51, (1, 6)), (60, 1))])
    ids = rng.permutation(len(rows))
    queries = np.concatenate([rows[:30] * 3, np.zeros((1, 6), int), np.eye(6, dtype=int)])
    own = np.concatenate([ids[:30], [-1] * 7])
    got = {j: (at, s, d) for j, at, s, d in SortedLists(rows, ids).top(queries, own, 5, slices)}
    assert sorted(got) == list(range(len(queries)))
    for j, (at, s, depth) in got.items():
        score = rows @ queries[j]
        best = [x for x in np.lexsort((ids, -score)) if ids[x] != own[j]][:5]
        assert list(at) == best and list(s) == list(score[best])
    if slices == 16:
        assert min(d for _, _, d in got.values()) < len(rows) / 2        # one-dimensional queries need little


def small_tiles(monkeypatch):
    monkeypatch.setattr(vectors, "SLAB_ROWS", 60)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)


def test_top_k_against_brute_force(spark, monkeypatch):
    small_tiles(monkeypatch)
    rows = sample()
    got = top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    small_tiles(monkeypatch)
    rows = sample(seed=1)
    got = sorted(map(tuple, hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    want = brute_negatives(rows, 10)
    assert len(want) > 300 and got == want


def test_few_rows(spark):
    for rows in ([], [(1, [1.0], 0)], [(0, [1.0], 0)], [(0, [0.0], 0), (3, [0.0], 0), (4, [0.0], 1)],
                 [(0, [-1.0], 0), (3, [1.0], 0), (4, [0.9], 1)], [(0, [], 0), (1, [], 0), (2, [], 1)]):
        df = frame(spark, rows, 2)
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute_top(rows, 50, 5)
        assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect())) == brute_negatives(rows, 100)


def test_a_hot_row_and_a_hot_id(spark, monkeypatch):
    """A third of the rows alike, a third with one id: no tile grows with them."""
    small_tiles(monkeypatch)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), i % 2) for i in range(100)] + [(0, [0.5] * 4, 1)] * 100 \
        + [(20, rng.normal(size=4).tolist(), 0) for _ in range(100)]
    got = top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)
    sizes = defaultdict(int)
    ints = vectors.integer_vectors(frame(spark, rows))
    for r in ints.select(F.pmod(F.xxhash64("vec_id", "key"), F.lit(4)).alias("slab")).collect():
        sizes[r.slab] += 1
    assert max(sizes.values()) < 100


def test_scores_beyond_a_long_raise(spark):
    df = frame(spark, [(0, [1e30], 0), (1, [1.0], 0)], 2)
    with pytest.raises(Exception, match="32 bits"):
        top_k(df, F.col("vec_id") % 50 == 0).collect()
