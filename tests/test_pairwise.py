"""Hand goldens and properties of win-rates, ties, z-tests, Sigma and rank-sets."""

import math

import numpy as np

from tandem.operators import pairwise as pw
from tandem.operators import ranking as rk

MODELS = ["x", "y", "z"]
ROWS = [  # noise, model_a, model_b, seed_a, seed_b, winner (orientation mixed)
    ("Coupled", "x", "y", 1, 2, "A"), ("Coupled", "y", "x", 3, 4, "A"), ("Coupled", "x", "y", 5, 6, "Tie"),
    ("Coupled", "z", "x", 7, 8, "B"), ("Coupled", "x", "z", 9, 10, "A"), ("Coupled", "y", "z", 11, 12, "Tie"),
    ("Independent", "x", "y", 1, 2, "B"), ("Independent", "z", "y", 3, 4, "A"), ("Independent", "x", "z", 5, 6, "Tie"),
    ("Independent", "y", "x", 7, 8, "B"), ("Independent", "x", "y", 9, 10, "A"), ("Independent", "q", "x", 1, 1, "A"),
]
SCHEMA = "noise string, model_a string, model_b string, seed_a long, seed_b long, winner string"


def canon(spark):
    return pw.canonical_pairs(spark.createDataFrame(ROWS, SCHEMA), MODELS)


def test_canonical_swaps_and_rejects(spark):
    c = canon(spark).orderBy("noise", "seed_a").collect()
    assert len(c) == 11                                       # unknown model 'q' rejected
    assert pw.unknown_model_rows(spark.createDataFrame(ROWS, SCHEMA), MODELS).count() == 1
    r = [x for x in c if x.noise == "Coupled" and x.seed_a == 4][0]  # (y, x, 3, 4, A) swapped
    assert (r.model_a, r.model_b, r.seed_a, r.seed_b, r.winner) == ("x", "y", 4, 3, "B")
    again = pw.canonical_pairs(canon(spark).drop("mrank_a", "mrank_b"), MODELS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, canon(spark).collect()))   # idempotent


def test_winrates_ties_golden(spark):
    counts = pw.pair_counts(canon(spark))
    for r in counts.collect():
        assert r.wins_a + r.wins_b + r.ties == r.n
    wr = {(r.noise, r.model, r.opponent): r.winrate for r in pw.pair_winrates(counts).collect()}
    # coupled x-y: rows A, (y,x,A)->B, Tie: x wins 1 of 3, y wins 1 of 3
    assert wr[("Coupled", "x", "y")] == 1 / 3 and wr[("Coupled", "y", "x")] == 1 / 3
    ties = {(r.noise, r.model, r.opponent): r.ties for r in pw.pair_ties(counts, MODELS).collect()}
    assert ties[("Coupled", "x", "y")] == ties[("Coupled", "y", "x")] == 1 and ties[("Coupled", "x", "x")] == 0
    assert len(ties) == 2 * 9


def test_ztest_golden(spark):
    z = {(r.model, r.opponent): r for r in pw.pair_ztest(pw.pair_counts(canon(spark))).collect()}
    r = z[("x", "y")]
    # coupled: x wins 1 of 3; independent (x,y,B),(y,x,B)->(x,y,A),(x,y,A): x wins 2 of 3
    ps, pd, p = 1 / 3, 2 / 3, 3 / 6
    assert math.isclose(r.z, (ps - pd) / math.sqrt(p * (1 - p) * (1 / 3 + 1 / 3)), rel_tol=1e-12)
    # y wins 1 of 3 under both noises (ties are nobody's wins), so its z is 0
    assert z[("y", "x")].z == 0.0 and z[("y", "x")].code == "ns"


def dense_sigma(rows, k):
    """A A^T / n^2 with the one-hot design, written out densely."""
    n = len(rows)
    m1, m2 = np.zeros((k, n)), np.zeros((k, n))
    w1, w2 = np.zeros(n), np.zeros(n)
    for i, (a, b, w) in enumerate(rows):
        m1[a, i] = 1
        m2[b, i] = 1
        w1[i] = w == "A"
        w2[i] = w == "B"
    theta = (m1 @ w1 + m2 @ w2) / (m1 + m2).sum(axis=1)
    A = m1 * (w1 - m1.T @ theta) + m2 * (w2 - m2.T @ theta)
    return theta, A @ A.T / n ** 2


def test_sigma_equals_dense_form(spark):
    c = canon(spark)
    counts = pw.pair_counts(c)
    th = rk.avg_winrate(counts)
    sg = rk.winrate_cov(counts, th, MODELS)
    for noise in ("Coupled", "Independent"):
        rows = [(r.mrank_a, r.mrank_b, r.winner) for r in c.filter(c.noise == noise).collect()]
        theta, sigma = dense_sigma(rows, 3)
        got_t = {r.model: r.theta for r in th.filter(th.noise == noise).collect()}
        got_s = {(r.model_i, r.model_j): r.sigma for r in sg.filter(sg.noise == noise).collect()}
        for i, a in enumerate(MODELS):
            assert math.isclose(got_t[a], theta[i], abs_tol=1e-12)
            for j, b in enumerate(MODELS):
                assert math.isclose(got_s[(a, b)], sigma[i, j], abs_tol=1e-13)
                assert math.isclose(got_s[(a, b)], got_s[(b, a)], abs_tol=1e-15)


def test_rank_sets_bounds(spark):
    counts = pw.pair_counts(canon(spark))
    th = rk.avg_winrate(counts)
    rs = rk.rank_sets(th, rk.winrate_cov(counts, th, MODELS), 3)
    for r in rs.collect():
        assert 1 <= r.lo <= r.hi <= 3


def test_rejects_and_accepted_rows_add_up(spark):
    rows = [("c", "x", "y", "A"), ("c", "y", "x", "B"), ("c", "x", "q", "A"), ("c", "q", "x", "A"), ("c", "q", "z", "Tie"), ("i", None, "x", "A")]
    df = spark.createDataFrame(rows, "noise string, model_a string, model_b string, winner string")
    got = {tuple(r) for r in pw.reject_counts(df, ["x", "y"]).collect()}
    assert got == {("c", "x", "q", "q", 1), ("c", "q", "x", "q", 1), ("c", "q", "z", "q", 1), ("i", None, "x", None, 1)}
    assert pw.canonical_pairs(df, ["x", "y"]).count() + sum(r[-1] for r in got) == len(rows)
