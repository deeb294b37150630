"""Density queries over the per-question variances and covariances (FIXTURE F2)."""

from __future__ import annotations

import math

from tandem.operators import density as de
from tandem.operators import paired as pa
from tandem.plans.q_paired import CP, CV, CYCLIC, MV, PD, VP, diffs, pivot
from tandem.plans.q_scores import _q
from tandem.plans.registry import query, rounded

G = de.GRIDSIZE
KEYS = ["subject", "model_a", "model_b"]
_SQ2PI = repr(math.sqrt(2 * math.pi))
_2PI = repr(2 * math.pi)

K1 = f"""st1 as (select subject, model_a, model_b, count(*) n, stddev_samp(cov) sd, min(cov) lo0, max(cov) hi0
  from cv where cov is not null group by all),
g1 as (select *, sd * pow(cast(n as double), -0.2e0) h from st1),
g2 as (select *, lo0 - 3e0 * h lo, ((hi0 + 3e0 * h) - (lo0 - 3e0 * h)) / {G - 1} step from g1 where n > 1 and h > 0),
p1 as (select subject, model_a, model_b, cov px, count(*) w from cv where cov is not null group by all),
k1 as (select g2.subject, g2.model_a, g2.model_b, gi, any_value(lo + gi * step) x,
   sum(w * exp(-0.5e0 * ((lo + gi * step) - px) / h * (((lo + gi * step) - px) / h))) / (any_value(n) * any_value(h) * {_SQ2PI}) density
  from p1 join g2 using (subject, model_a, model_b) cross join (select cast(unnest(range(0, {G})) as int) gi) gg
  group by g2.subject, g2.model_a, g2.model_b, gi)"""


@query("kde_1d", _q("select subject, model_a, model_b, gi, round(x, 9) x, round(density, 9) density from k1", CP, CV, K1))
def kde_1d(spark, sf):
    """Density of the per-question covariances per (subject, pair)."""
    cov = pa.question_cov(pa.paired_rows(pivot(spark, sf), CYCLIC))
    return rounded(de.kde_1d(cov, "cov", KEYS), 9)


@query("kde_at_mean", _q("""select m.subject, m.model_a, m.model_b, round(m.mean, 9) mean, round(b.x, 9) x_at, round(b.density, 9) density_at
from (select subject, model_a, model_b, avg(cov) mean from cv group by all) m
join (select k1.subject, k1.model_a, k1.model_b, k1.x, k1.density, row_number() over (partition by k1.subject, k1.model_a, k1.model_b
      order by abs(k1.x - mm.mean), k1.gi) rn from k1 join (select subject, model_a, model_b, avg(cov) mean from cv group by all) mm
      using (subject, model_a, model_b)) b on b.subject = m.subject and b.model_a = m.model_a and b.model_b = m.model_b and b.rn = 1""",
                         CP, CV, K1))
def kde_at_mean(spark, sf):
    """Mean covariance and the density at the nearest grid point."""
    cov = pa.question_cov(pa.paired_rows(pivot(spark, sf), CYCLIC))
    return rounded(de.density_at_mean(cov, "cov", KEYS, de.kde_1d(cov, "cov", KEYS)), 9)


K2 = f"""st2 as (select subject, model_a, model_b, count(*) n, var_samp(coupled) vx, var_samp(independent) vy,
   covar_samp(coupled, independent) cxy, min(coupled) x0, max(coupled) x1, min(independent) y0, max(independent) y1
  from vp where coupled is not null and independent is not null group by all),
h2 as (select *, vx * pow(cast(n as double), -1e0 / 3e0) hxx, vy * pow(cast(n as double), -1e0 / 3e0) hyy,
   cxy * pow(cast(n as double), -1e0 / 3e0) hxy from st2),
d2 as (select *, hxx * hyy - hxy * hxy det from h2),
gr2 as (select *, x0 - 3e0 * sqrt(hxx) lox, y0 - 3e0 * sqrt(hyy) loy,
   ((x1 + 3e0 * sqrt(hxx)) - (x0 - 3e0 * sqrt(hxx))) / {G - 1} sx, ((y1 + 3e0 * sqrt(hyy)) - (y0 - 3e0 * sqrt(hyy))) / {G - 1} sy
  from d2 where n > 2 and det > 0),
p2 as (select subject, model_a, model_b, coupled px, independent py, count(*) w from vp
  where coupled is not null and independent is not null group by all),
c2 as (select gr2.subject, gr2.model_a, gr2.model_b, gi, gj, gr2.n, gr2.det, lox + gi * sx gx, loy + gj * sy gy, w,
   (lox + gi * sx) - px dx, (loy + gj * sy) - py dy, hxx, hyy, hxy
  from p2 join gr2 using (subject, model_a, model_b) cross join (select cast(unnest(range(0, {G})) as int) gi) a
  cross join (select cast(unnest(range(0, {G})) as int) gj) b),
k2 as (select subject, model_a, model_b, gi, gj, any_value(gx) x, any_value(gy) y,
   sum(w * exp(-0.5e0 * ((hyy * dx * dx - 2 * hxy * dx * dy + hxx * dy * dy) / det))) / (any_value(n) * {_2PI} * sqrt(any_value(det))) density
  from c2 group by all)"""


@query("kde_2d", _q("select subject, model_a, model_b, gi, gj, round(x, 9) x, round(y, 9) y, round(density, 7) density from k2",
                    PD, MV, VP, K2))
def kde_2d(spark, sf):
    """Joint density of (coupled, independent) per-question variances per (subject, pair)."""
    vp = pa.pivot_noise(pa.metric_per_question(diffs(spark, sf), "var"), "var")
    return rounded(de.kde_2d(vp, "coupled", "independent", KEYS), 9, density=7)
