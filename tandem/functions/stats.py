"""Scalar statistics used as literals (driver-side scalars only) and the p-value column.

Neither Spark nor DuckDB has ``erf``; SciPy is not available. The two-sided normal
p-value is an Arrow-batched pandas UDF over ``math.erfc`` (applied to tiny pair
tables), and the chi-square quantile is a scalar computed once on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def two_sided_p(z: float) -> float:
    return 2.0 * norm_sf(abs(z))


def z_cutoff(p: float) -> float:
    """|z| whose two-sided p-value equals ``p`` (bisection on erfc)."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if two_sided_p(mid) > p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def _gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma P(a, x)."""
    if x <= 0.0:
        return 0.0
    log_pre = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        # power series
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(10000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-17:
                break
        return total * math.exp(log_pre)
    # continued fraction for Q(a, x) (modified Lentz)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-17:
            break
    return 1.0 - math.exp(log_pre) * h


def chi2_cdf(x: float, k: int) -> float:
    return _gamma_p(k / 2.0, x / 2.0)


def chi2_ppf(q: float, k: int) -> float:
    """Quantile of the chi-square distribution with ``k`` degrees of freedom."""
    if not 0.0 < q < 1.0:
        raise ValueError("q must be in (0, 1)")
    lo, hi = 0.0, max(1.0, float(k))
    while chi2_cdf(hi, k) < q:
        hi *= 2.0
    for _ in range(300):
        mid = 0.5 * (lo + hi)
        if chi2_cdf(mid, k) < q:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


# ---- fixed values: significance codes by p-value cut-off (P15) ----------------------
# p < 0.0001 -> '****', p < 0.001 -> '***', p < 0.01 -> '**', p < 0.05 -> '*', else 'ns'
SIGNIFICANCE = [(0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*")]


def significance_code(z: Column) -> Column:
    """Significance code of a two-sided z-test, from |z| cut-offs equivalent to the p
    cut-offs (so no p-value is needed); undefined z -> 'ns'."""
    expr = None
    for p, code in SIGNIFICANCE:
        cond = F.abs(z) > F.lit(z_cutoff(p))
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    return F.coalesce(expr.otherwise("ns"), F.lit("ns"))


def significance_code_sql(z: str) -> str:
    parts = " ".join(f"when abs({z}) > {z_cutoff(p)!r}e0 then '{c}'" for p, c in SIGNIFICANCE)
    return f"coalesce(case {parts} else 'ns' end, 'ns')"


def p_value(z: Column) -> Column:
    """Two-sided normal p-value erfc(x), x = abs(z) / sqrt 2, as a column expression; undefined z -> NULL.

    Below 2, one minus the series erf(x) = 2 x exp(-x^2) / sqrt(pi) * sum (2 x^2)^n / (2n + 1)!!, whose terms are positive;
    from 2 on, the continued fraction exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + (2/2) / (x + ...))), which keeps
    the leading digits of very small values. Both are folds over a fixed range (errors below 1e-12 of the value)."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    term = lambda acc, n: acc["t"] * 2 * x * x / (2 * n + 1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                         lambda acc, n: F.struct(term(acc, n).alias("t"), (acc["s"] + term(acc, n)).alias("s")), lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / F.lit(2.0) / acc)
    tail = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    return F.when(F.isnan(z), None).when(x < 2, 1 - 2 * x * tail * series).otherwise(tail / fraction)
