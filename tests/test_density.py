"""Kernel densities against a dense numpy restatement."""

import math

import numpy as np

from tandem.operators import density as de


def test_kde_1d_dense(spark):
    rng = np.random.default_rng(0)
    xs = np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([("g", float(x)) for x in xs], "k string, x double")
    got = sorted((r.gi, r.x, r.density) for r in de.kde_1d(df, "x", ["k"], gridsize=50).collect())
    h = xs.std(ddof=1) * len(xs) ** -0.2
    grid = xs.min() - 3 * h + np.arange(50) * ((xs.max() + 3 * h) - (xs.min() - 3 * h)) / 49
    dens = np.exp(-0.5 * ((grid[:, None] - xs[None, :]) / h) ** 2).sum(1) / (len(xs) * h * math.sqrt(2 * math.pi))
    assert np.allclose([g[1] for g in got], grid) and np.allclose([g[2] for g in got], dens)
    assert abs(np.trapezoid(dens, grid) - 1) < 1e-3


def test_kde_2d_dense_and_singular(spark):
    rng = np.random.default_rng(1)
    pts = np.round(rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 2]], size=40), 1)
    rows = [("g", float(a), float(b)) for a, b in pts] + [("flat", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = de.kde_2d(df, "x", "y", ["k"], gridsize=30).collect()
    assert {r.k for r in got} == {"g"}                         # zero-variance group: no rows
    n = len(pts)
    H = np.cov(pts.T) * n ** (-1 / 3)
    inv, det = np.linalg.inv(H), np.linalg.det(H)
    for r in got[:50]:
        d = np.array([r.x, r.y]) - pts
        q = np.einsum("pi,ij,pj->p", d, inv, d)
        assert math.isclose(r.density, np.exp(-0.5 * q).sum() / (n * 2 * math.pi * math.sqrt(det)), rel_tol=1e-9)


def test_factored_kernel_sums():
    """Row and column factors against one exponential per point and cell, up to nearly singular kernels and far outliers."""
    from tandem.operators.density import kernel_grid
    rng = np.random.default_rng(0)
    for n, rho, scale in ((600, 0.5, 1), (300, -0.95, 1e3), (400, 0.9999, 1e-4), (300, -0.9999999, 1), (50, 0.0, 1)):
        p = rng.normal(size=(n, 2)) * [1, 2] * scale + [5 * scale, 0]
        p[:, 1] = rho * p[:, 0] + np.sqrt(1 - rho * rho) * p[:, 1]
        p[0] *= 8
        w = rng.integers(1, 9, n).astype(float)
        c = np.cov(p.T) * n ** (-1 / 3)
        gx, gy = (np.linspace(p[:, d].min() - 3 * c[d, d] ** 0.5, p[:, d].max() + 3 * c[d, d] ** 0.5, 60) for d in (0, 1))
        got = kernel_grid(gx, gy, p[:, 0], p[:, 1], w, c[0, 0], c[1, 1], c[0, 1])
        dx, dy = gx[:, None, None] - p[:, 0], gy[None, :, None] - p[:, 1]
        inv = np.linalg.inv(c)
        ref = (w * np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy))).sum(2)
        assert np.isfinite(got).all() and np.abs(got - ref).max() < 1e-8 * ref.max(), (n, rho)


def test_null_groups_have_densities(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(a), float(a + b)) for g in (None, "x") for a, b in rng.normal(size=(40, 2))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    one = de.kde_1d(df, "x", ["g"], gridsize=20)
    assert {(r.g, r["count"]) for r in one.groupBy("g").count().collect()} == {(None, 20), ("x", 20)}
    assert {(r.g, r["count"]) for r in de.kde_2d(df, "x", "y", ["g"], gridsize=10).groupBy("g").count().collect()} == {(None, 100), ("x", 100)}
    assert {r.g for r in de.density_at_mean(df, "x", ["g"], one).collect()} == {None, "x"}
