"""Gaussian kernel densities on a regular grid.

Same definition as the plotting defaults of the reference's figures: Scott's factor
n^(-1/(d+4)) times the sample covariance (ddof 1) as kernel covariance, a grid of
``gridsize`` points per axis from min - cut * bw to max + cut * bw (bw = kernel
standard deviation of the axis), cut = 3, gridsize = 200.

Identical points are merged first (a weight per distinct point: exact). In 1-D each
distinct point emits its contribution to every grid point and the contributions are
summed with a partial (map-side) aggregation; in 2-D each task sums its points onto the
grid, tile by tile, as products of row and column factors (:func:`kernel_grid`) and emits partial grids. No group is gathered in one
task. A null key is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators.indexing import _null_safe_join
from tandem.session import write_once

# ---- fixed values: plotting defaults --------------------------------------------------
GRIDSIZE = 200
CUT = 3.0
POINTS = 20_000     # distinct points summed by one task
TILE = 1.0          # width of a tile of points, in kernel standard deviations
ROWS = 16.0         # height of a tile of grid rows, likewise
REACH = 37.0        # exp(-REACH^2 / 2) is about 1e-297


def _salted(points: DataFrame, keys: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """Distinct weighted points with a salt, so that no (group, salt) holds more than about
    ``POINTS`` of them (``n`` is the group's size)."""
    return points.withColumn("salt", F.pmod(F.xxhash64(*coords), F.ceil(F.col("n") / F.lit(POINTS))).cast("int"))


def _sum_cells(points: DataFrame, keys: list[str], fn, rows: str) -> DataFrame:
    """Kernel sums on a grid: one grid per (group, salt), sent on as arrays, added per cell."""
    fields = [f for f in points.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField(rows, T.IntegerType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])
    partial = points.groupBy(*keys, "salt").applyInPandas(fn, schema)
    return partial.select(*keys, rows, F.posexplode("cells").alias("_cell", "s")) \
        .groupBy(*keys, rows, "_cell").agg(F.sum("s").alias("s"))


def kde_1d(df: DataFrame, x: str, keys: Sequence[str], gridsize: int = GRIDSIZE, cut: float = CUT) -> DataFrame:
    """Density of ``x`` per group on ``gridsize`` points: (keys, gi, x, density).
    Groups with fewer than two points or zero spread give no rows."""
    keys = list(keys)
    d = write_once(df.filter(F.col(x).isNotNull()).select(*keys, x))     # read for the statistics and for the points
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"),
                              F.min(x).alias("lo0"), F.max(x).alias("hi0")) \
        .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))) \
        .filter((F.col("n") > 1) & (F.col("h") > 0)) \
        .withColumn("lo", F.col("lo0") - F.lit(cut) * F.col("h")) \
        .withColumn("step", ((F.col("hi0") + F.lit(cut) * F.col("h")) - F.col("lo")) / F.lit(gridsize - 1)) \
        .select(*keys, "n", "h", "lo", "step")
    pts = d.groupBy(*keys, F.col(x).alias("px")).agg(F.count(F.lit(1)).cast("double").alias("w"))

    def sums(key, pdf):
        h, lo, step = (float(pdf[c].iloc[0]) for c in ("h", "lo", "step"))
        grid = lo + np.arange(gridsize) * step
        total = np.zeros(gridsize)
        px, w = (pdf[c].to_numpy(dtype=np.float64) for c in ("px", "w"))
        for k in range(0, len(px), 4096):
            total += w[k:k + 4096] @ np.exp(-0.5 * ((grid[None, :] - px[k:k + 4096, None]) / h) ** 2)
        return pd.DataFrame([(*key[:-1], 0, total)], columns=[*keys, "row", "cells"])

    summed = _sum_cells(_salted(_null_safe_join(pts, st, keys), keys, ["px"]), keys, sums, "row")
    out = _null_safe_join(summed, st, keys)
    return out.select(*keys, F.col("_cell").alias("gi"), (F.col("lo") + F.col("_cell") * F.col("step")).alias("x"),
                      (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def kde_2d(df: DataFrame, x: str, y: str, keys: Sequence[str], gridsize: int = GRIDSIZE,
           cut: float = CUT) -> DataFrame:
    """Bivariate density of (x, y) per group on a gridsize x gridsize grid:
    (keys, gi, gj, x, y, density). A singular covariance gives no rows.

    The (distinct, weighted) points of a group are dealt in salted parts; each part adds its kernels
    to one grid in numpy, and Spark adds the parts' grids per cell."""
    keys = list(keys)
    d = write_once(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y))
    f2 = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    cols = ["hxx", "hyy", "hxy", "det", "lox", "loy", "sx", "sy"]
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"),
                              F.covar_samp(x, y).alias("cxy"), F.min(x).alias("x0"), F.max(x).alias("x1"),
                              F.min(y).alias("y0"), F.max(y).alias("y1")) \
        .withColumn("hxx", F.col("vx") * f2).withColumn("hyy", F.col("vy") * f2).withColumn("hxy", F.col("cxy") * f2) \
        .withColumn("det", F.col("hxx") * F.col("hyy") - F.col("hxy") * F.col("hxy")) \
        .filter((F.col("n") > 2) & (F.col("det") > 0)) \
        .withColumn("lox", F.col("x0") - F.lit(cut) * F.sqrt("hxx")) \
        .withColumn("loy", F.col("y0") - F.lit(cut) * F.sqrt("hyy")) \
        .withColumn("sx", ((F.col("x1") + F.lit(cut) * F.sqrt("hxx")) - F.col("lox")) / F.lit(gridsize - 1)) \
        .withColumn("sy", ((F.col("y1") + F.lit(cut) * F.sqrt("hyy")) - F.col("loy")) / F.lit(gridsize - 1)) \
        .select(*keys, "n", *cols)
    pts = d.groupBy(*keys, F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count(F.lit(1)).cast("double").alias("w"))

    def sums(key, pdf):
        r = {c: float(pdf[c].iloc[0]) for c in cols}
        gx, gy = r["lox"] + np.arange(gridsize) * r["sx"], r["loy"] + np.arange(gridsize) * r["sy"]
        total = kernel_grid(gx, gy, *(pdf[c].to_numpy(dtype=np.float64) for c in ("px", "py", "w")), r["hxx"], r["hyy"], r["hxy"])
        return pd.DataFrame([(*key[:-1], i, total[i]) for i in range(gridsize)], columns=[*keys, "gi", "cells"])

    summed = _sum_cells(_salted(_null_safe_join(pts, st, keys), keys, ["px", "py"]), keys, sums, "gi")
    out = _null_safe_join(summed, st, keys)
    return out.select(*keys, "gi", F.col("_cell").alias("gj"), (F.col("lox") + F.col("gi") * F.col("sx")).alias("x"),
                      (F.col("loy") + F.col("_cell") * F.col("sy")).alias("y"),
                      (F.col("s") / (F.col("n") * F.lit(2 * math.pi) * F.sqrt("det"))).alias("density"))


def kernel_grid(gx: np.ndarray, gy: np.ndarray, px: np.ndarray, py: np.ndarray, w: np.ndarray,
                hxx: float, hyy: float, hxy: float) -> np.ndarray:
    """Sum of w * exp(-q / 2) over points, at every grid point; q = d' H^-1 d, d = grid - point.

    With u = dx / sqrt(hxx) and v = (dy - hxy / hxx * dx) / s, s^2 = hyy - hxy^2 / hxx, q is u^2 + v^2, and v is t - tau: t a
    number of the grid point, tau one of the point. exp(-(t - tau)^2 / 2) = exp(-t^2 / 2) exp(t tau) exp(-tau^2 / 2), and t is a sum of a
    row's and a column's number, so exp(t tau) is a product of two factors: the points' kernels are one matrix
    product of their row and column factors instead of an exponential per point and cell. Points are dealt to tiles of
    ``TILE`` in tau, grid rows to tiles of ``ROWS`` in t, and a pair of tiles adds to the columns within ``REACH`` only (a
    kernel beyond is below 1e-290), with all numbers taken from the tiles' middles: exponents stay small."""
    slope = hxy / hxx
    s = math.sqrt(hyy - hxy * slope)
    tau, row, col = (py - slope * px) / s, slope * gx / s, gy / s
    tile, band = np.floor(tau / TILE), np.floor(row / ROWS)
    bands = [(np.flatnonzero(band == b), (b + 0.5) * ROWS) for b in np.unique(band)]
    total = np.zeros((len(gx), len(gy)))
    for k in np.unique(tile):
        at = tile == k
        middle = (k + 0.5) * TILE
        near, weight = tau[at] - middle, w[at]
        u = (gx[None, :] - px[at][:, None]) / math.sqrt(hxx)
        for i, centre in bands:
            c = col - centre - middle
            j = np.flatnonzero(np.abs(c) < REACH + ROWS)
            r, c = row[i] - centre, c[j]
            left = weight[:, None] * np.exp(-0.5 * u[:, i] * u[:, i] - r[None, :] * near[:, None] - 0.5 * (near * near)[:, None])
            right = np.exp(c[None, :] * near[:, None])
            t = c[None, :] - r[:, None]
            total[np.ix_(i, j)] += np.exp(-0.5 * t * t) * (left.T @ right)
    return total


def density_at_mean(df: DataFrame, x: str, keys: Sequence[str], curve: DataFrame) -> DataFrame:
    """Mean of ``x`` per group and the curve's density at the grid point nearest to it
    (ties to the lower grid point)."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(x).alias("mean"))
    j = _null_safe_join(curve, m, keys)
    best = j.groupBy(*keys).agg(F.first("mean").alias("mean"),
                                F.min(F.struct(F.abs(F.col("x") - F.col("mean")).alias("dist"), F.col("gi"),
                                               F.col("x"), F.col("density"))).alias("b"))
    return best.select(*keys, "mean", F.col("b.x").alias("x_at"), F.col("b.density").alias("density_at"))
