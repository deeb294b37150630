"""Sub-sampling error: both execution paths against a brute-force restatement."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tandem.functions.hashing import MIX_P, mix_np
from tandem.operators import subsample as ss


def fixture(spark):
    rows = []
    rng = np.random.default_rng(3)
    for g, size in (("a", 90), ("b", 250)):
        for q in range(size):
            rows.append((g, q, int(rng.integers(-1, 2)), int(rng.integers(-1, 2))))
    return spark.createDataFrame(rows, "g string, q long, v1 int, v2 int")


def brute(rows, iterations, step, seed):
    out = {}
    by = {}
    for g, q, v1, v2 in rows:
        by.setdefault(g, []).append((q, v1, v2))
    for g, items in by.items():
        n_total = len(items)
        r = np.array([int(hashlib.md5(f"{seed}|{g}|{q}".encode()).hexdigest()[:8], 16) % MIX_P for q, _, _ in items])
        v = np.array([[a, b] for _, a, b in items], dtype=float)
        ref = v.mean(axis=0)
        for it in range(iterations):
            h = mix_np(r, np.int64(it))
            order = sorted(range(n_total), key=lambda i: (h[i], items[i][0]))
            cs = np.cumsum(v[order], axis=0)
            for n in range(step, n_total, step):
                out[(g, it, n)] = tuple(np.abs(ref - cs[n - 1] / n))
    return out


def run(spark, bucket_rows):
    df = fixture(spark)
    e = ss.subsample_error(df, ["v1", "v2"], ["g"], ["q"], iterations=7, step=20, seed=5, bucket_rows=bucket_rows)
    return {(r.g, r.iter, r.n): (r.err_v1, r.err_v2) for r in e.collect()}, df


def test_block_and_bucket_paths_equal_brute_force(spark):
    small, df = run(spark, 10_000)       # every group fits one bucket: grouped numpy path
    bucketed, _ = run(spark, 40)         # several buckets per group: JVM window path
    exp = brute([tuple(r) for r in df.collect()], 7, 20, 5)
    assert set(small) == set(exp) == set(bucketed)
    for k, v in exp.items():
        assert np.allclose(small[k], v, atol=1e-12) and np.allclose(bucketed[k], v, atol=1e-12), k


def test_error_mean_and_samples_needed(spark):
    df = fixture(spark)
    e = ss.subsample_error(df, ["v1"], ["g"], ["q"], iterations=5, step=20, seed=1)
    el = ss.to_long(e, ["g", "iter", "n"], {"v1": ("m1", "m2")})
    em = ss.error_mean(el, ["g", "model_a", "model_b"])
    raw = {}
    for r in el.collect():
        raw.setdefault((r.g, r.n), []).append(r.err)
    for r in em.collect():
        assert r.iterations == 5 and abs(r.mean_err - np.mean(raw[(r.g, r.n)])) < 1e-12
    need = ss.samples_needed(em, ["g", "model_a", "model_b"], 0.05).collect()
    for r in need:
        ok = sorted(n for (g, n), v in raw.items() if g == r.g and np.mean(v) <= 0.05)
        assert r.n_needed == (ok[0] if ok else None)


def test_error_curve_interval_contains_mean(spark):
    df = fixture(spark)
    el = ss.to_long(ss.subsample_error(df, ["v1"], ["g"], ["q"], iterations=50, step=20, seed=2),
                    ["g", "iter", "n"], {"v1": ("m1", "m2")}).select("g", "iter", "n", "model_a", "model_b", "err")
    for r in ss.error_curve(el, ["g", "model_a", "model_b"], draws=200, iterations=50).collect():
        assert r.iterations == 50 and r.ci_lo <= r.mean_err <= r.ci_hi


def test_reduced_means_equal_per_iteration_means(spark):
    df = fixture(spark)
    for bucket_rows in (10_000, 40):
        e = ss.subsample_error(df, ["v1", "v2"], ["g"], ["q"], iterations=9, step=20, seed=4, bucket_rows=bucket_rows)
        el = ss.to_long(e, ["g", "iter", "n"], {"v1": ("m", "v1"), "v2": ("m", "v2")})
        full = {(r.g, r.model_b, r.n): (r.iterations, r.mean_err) for r in ss.error_mean(el, ["g", "model_a", "model_b"]).collect()}
        m = ss.subsample_error(df, ["v1", "v2"], ["g"], ["q"], iterations=9, step=20, seed=4, bucket_rows=bucket_rows,
                               reduce=True).collect()
        red = {}
        for r in m:
            red[(r.g, "v1", r.n)] = (r.iterations, r.mean_v1)
            red[(r.g, "v2", r.n)] = (r.iterations, r.mean_v2)
        assert red == full


def test_large_sums_do_not_overflow(spark):
    """Values near 1e15 in 250 rows: |S n - p N| passes 64 bits."""
    from fractions import Fraction
    rng = np.random.default_rng(4)
    rows = [("b", q, int(rng.integers(-10**15, 10**15)) + 10**15) for q in range(250)]
    df = spark.createDataFrame(rows, "g string, q long, v long")
    total = sum(r[2] for r in rows)
    r = np.array([int(hashlib.md5(f"0|b|{q}".encode()).hexdigest()[:8], 16) % MIX_P for _, q, _ in rows])
    exp = {}
    for it in range(3):
        h = mix_np(r, np.int64(it))
        order = sorted(range(250), key=lambda i: (h[i], i))
        for n in range(20, 250, 20):
            exp[it, n] = float(abs(Fraction(total, 250) - Fraction(sum(rows[i][2] for i in order[:n]), n)))
    for size in (10_000, 40):
        e = ss.subsample_error(df, ["v"], ["g"], ["q"], iterations=3, step=20, bucket_rows=size)
        got = {(x.iter, x.n): x.err_v for x in e.collect()}
        assert set(got) == set(exp) and all(np.isclose(got[k], exp[k], rtol=1e-12) for k in exp)
        m = ss.subsample_error(df, ["v"], ["g"], ["q"], iterations=3, step=20, bucket_rows=size, reduce=True)
        for x in m.collect():
            assert np.isclose(x.mean_v, np.mean([exp[i, x.n] for i in range(3)]), rtol=1e-12)


def test_every_bucket_count_gives_the_same_errors(spark):
    """One bucket, a few, more buckets than rows: the bucket count decides nothing but the split."""
    df = fixture(spark)
    exp = brute([tuple(r) for r in df.collect()], 7, 20, 5)
    for bucket_rows in (120, 30, 3, 1):
        got, _ = run(spark, bucket_rows)
        assert set(got) == set(exp)
        assert all(np.allclose(got[k], exp[k], atol=1e-12) for k in exp), bucket_rows


def test_small_cells_and_slices(spark, monkeypatch):
    """Blocks of one iteration, slices of a few pairs."""
    monkeypatch.setattr(ss, "CELL_PAIRS", 100)
    df = fixture(spark)
    exp = brute([tuple(r) for r in df.collect()], 7, 20, 5)
    for bucket_rows in (10_000, 40):
        got, _ = run(spark, bucket_rows)
        assert set(got) == set(exp) and all(np.allclose(got[k], exp[k], atol=1e-12) for k in exp)


def test_fractional_values_and_null_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, q, float(rng.normal())) for g, size in ((None, 70), ("b", 110), ("tiny", 3)) for q in range(size)]
    df = spark.createDataFrame(rows, "g string, q long, v double")
    exp = {}
    for g in (None, "b"):
        v = np.array([x for h, _, x in rows if h == g])
        key = "4" if g is None else f"4|{g}"                  # concat_ws leaves nulls out
        r = np.array([int(hashlib.md5(f"{key}|{q}".encode()).hexdigest()[:8], 16) % MIX_P for q in range(len(v))])
        for it in range(5):
            h = mix_np(r, np.int64(it))
            c = np.cumsum(v[sorted(range(len(v)), key=lambda i: (h[i], i))])
            for n in range(20, len(v), 20):
                exp[g, it, n] = abs(v.mean() - c[n - 1] / n)
    for bucket_rows in (1000, 25):
        e = ss.subsample_error(df, ["v"], ["g"], ["q"], iterations=5, step=20, seed=4, bucket_rows=bucket_rows)
        assert e.columns == ["g", "iter", "n", "err_v"]
        got = {(x.g, x.iter, x.n): x.err_v for x in e.collect()}
        assert set(got) == set(exp) and all(abs(got[k] - exp[k]) < 1e-12 for k in exp)
    assert ss.subsample_error(df.where("g = 'tiny'"), ["v"], ["g"], ["q"], iterations=5).count() == 0
    assert ss.subsample_error(df.where("false"), ["v"], ["g"], ["q"], iterations=5).count() == 0


def test_poisson_weights_agree_and_are_poisson(spark):
    import duckdb

    from tandem.functions.hashing import (POISSON_STEPS, poisson_weight, poisson_weight_np, poisson_weight_sql, row_seed,
                                          row_seed_py)
    seeds = np.array([row_seed_py(9, "boot", i) for i in range(200)])
    w = poisson_weight_np(seeds[None, :], np.arange(300)[:, None])
    df = spark.range(200).select(F.col("id"), row_seed(F.lit(9), "'boot'", F.col("id")).alias("r")) \
        .crossJoin(spark.range(300).select(F.col("id").alias("d")))
    got = {(r.d, r.id): r.w for r in df.select("d", "id", poisson_weight(F.col("r"), F.col("d")).alias("w")).collect()}
    assert all(got[d, i] == w[d, i] for d in range(300) for i in range(200))
    sql = f"select d, r, {poisson_weight_sql('r', 'd')} from (select unnest({seeds.tolist()}) r), (select unnest(range(300)) d)"
    assert sorted(duckdb.sql(sql).fetchall()) == sorted((d, int(seeds[i]), int(w[d, i])) for d in range(300) for i in range(200))
    import math
    for k, t in enumerate(POISSON_STEPS):
        assert abs(t / MIX_P - sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) < 1e-8
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_error_curve_against_a_plain_bootstrap(spark):
    from tandem.functions.hashing import poisson_weight_np, row_seed_py
    rng = np.random.default_rng(8)
    rows = [(g, n, i, float(rng.exponential())) for g in ("a", "b") for n in (20, 40) for i in range(30) if (g, i) != ("b", 7)]
    df = spark.createDataFrame(rows, "g string, n long, iter int, err double")
    seeds = np.array([row_seed_py(3, "boot", i) for i in range(30)])
    for r in ss.error_curve(df, ["g"], draws=150, seed=3, level=0.9, iterations=30).collect():
        mine = [(i, e) for g, n, i, e in rows if (g, n) == (r.g, r.n)]
        means = []
        for d in range(150):
            w = [int(poisson_weight_np(seeds[i], np.int64(d))) for i, _ in mine]
            if sum(w):
                means.append(sum(a * e for a, (_, e) in zip(w, mine)) / sum(w))
        assert r.iterations == len(mine) and abs(r.mean_err - np.mean([e for _, e in mine])) < 1e-12
        assert np.allclose([r.ci_lo, r.ci_hi], np.percentile(means, [5, 95]), atol=1e-12)


def test_levels_by_key(spark):
    curve = spark.createDataFrame([(s, m, n, 1 / n) for s in ("x", None) for m in ("p", "q") for n in (10, 20, 40)],
                                  "s string, m string, n long, mean_err double")
    levels = spark.createDataFrame([("x", "p", 0.05), ("x", "p", 0.1), ("x", "p", 0.1), (None, "q", 0.02), ("none", "p", 1.0)],
                                   "s string, m string, level double")
    got = {tuple(r) for r in ss.samples_needed(curve, ["s", "m"], levels).collect()}
    assert got == {("x", "p", 0.05, 20), ("x", "p", 0.1, 10), (None, "q", 0.02, None)}
    by_m = {tuple(r) for r in ss.samples_needed(curve, ["s", "m"], levels.where("s = 'x'").select("m", "level")).collect()}
    assert by_m == {(s, "p", lv, n) for s in ("x", None) for lv, n in ((0.05, 20), (0.1, 10))}
