"""Queries over pairwise judgements (FIXTURES F3): E3 of the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.stats import chi2_ppf, p_value, significance_code_sql
from tandem.operators import pairwise as pw
from tandem.operators import ranking as rk
from tandem.plans.oracle import CANON, F3, lit_double, sql, sql_list
from tandem.plans.registry import query, rounded
from tandem.session import write_once
from tandem.sources import fixtures as fx

K = len(fx.CMP_MODELS)
ALPHA = 0.05


def canon(spark, sf):
    return pw.canonical_pairs(fx.comparisons(spark, sf), fx.CMP_MODELS)


def counts(spark, sf):
    # at most k(k-1)/2 rows per noise, by the model list: written once, then read by every statistic
    return F.broadcast(write_once(pw.pair_counts(canon(spark, sf))))


def theta_sigma(spark, sf):
    c = counts(spark, sf)
    th = rk.avg_winrate(c)
    return th, rk.winrate_cov(c, th, fx.CMP_MODELS)


def _q(body: str, *more: str) -> str:
    """Oracle SQL: fixture F3, canonical pairs and counts, then ``more`` CTEs and ``body``."""
    return sql(body, ("f3", F3), raw=",\n".join([CANON, *more]))


_GRID = f"""grid as (select noise, model, opponent from (select unnest(['Coupled','Independent']) noise) nz,
  (select unnest({sql_list(fx.CMP_MODELS)}) model) m, (select unnest({sql_list(fx.CMP_MODELS)}) opponent) o)"""

_TH = "th as (select noise, model, mrank, sum(n) appearances, sum(wins) wins, sum(wins) / sum(n) theta from oriented group by all)"
_SG = f"""c as (select counts.*, a.theta ta, b.theta tb from counts join th a on a.noise = counts.noise and a.model = counts.model_a
  join th b on b.noise = counts.noise and b.model = counts.model_b),
parts as (select noise, model_a mi, model_a mj, wins_a * (1 - ta) * (1 - ta) + (n - wins_a) * ta * ta v from c
  union all select noise, model_b, model_b, wins_b * (1 - tb) * (1 - tb) + (n - wins_b) * tb * tb from c
  union all select noise, model_a, model_b, wins_a * (1 - ta) * (-tb) + wins_b * (-ta) * (1 - tb) + ties * ta * tb from c
  union all select noise, model_b, model_a, wins_a * (1 - ta) * (-tb) + wins_b * (-ta) * (1 - tb) + ties * ta * tb from c),
tot as (select noise, sum(n) nt from counts group by all),
s0 as (select p.noise, mi, mj, sum(v) / (cast(any_value(nt) as double) * any_value(nt)) sigma from parts p join tot using (noise) group by p.noise, mi, mj),
{_GRID},
sg as (select g.noise, g.model model_i, g.opponent model_j, coalesce(s0.sigma, 0e0) sigma from grid g
  left join s0 on s0.noise = g.noise and s0.mi = g.model and s0.mj = g.opponent)"""
_RS = f"""d as (select s.noise, s.model_i, s.model_j, t1.theta t1, t2.theta t2, s11.sigma s11, s22.sigma s22, s.sigma s12
  from sg s join th t1 on t1.noise = s.noise and t1.model = s.model_i join th t2 on t2.noise = s.noise and t2.model = s.model_j
  join sg s11 on s11.noise = s.noise and s11.model_i = s.model_i and s11.model_j = s.model_i
  join sg s22 on s22.noise = s.noise and s22.model_i = s.model_j and s22.model_j = s.model_j
  where s.model_i <> s.model_j),
dd as (select *, abs(t1 - t2) / sqrt(2e0) - sqrt((s11 + s22 - 2 * s12) * {lit_double(chi2_ppf(1 - ALPHA, K) / 2.0)}) dv from d),
r as (select noise, model_i model, cast(1 + sum(case when dv > 0 and t1 < t2 then 1 else 0 end) as int) lo,
   cast({K} - sum(case when dv > 0 and t1 > t2 then 1 else 0 end) as int) hi from dd group by all),
rs as (select th.noise, th.model, coalesce(r.lo, 1) lo, coalesce(r.hi, {K}) hi from th left join r using (noise, model))"""


@query("pair_canonical", _q("select * from canon"))
def pair_canonical(spark, sf):
    """Comparisons in canonical model order."""
    return canon(spark, sf)


KNOWN = fx.CMP_MODELS[:-1]       # a model list without one of the models that were compared


@query("pair_rejects", _q(f"""select noise, model_a, model_b, case when list_position({sql_list(KNOWN)}, model_a) is null then model_a else model_b end unknown,
  count(*) n from f3 where list_position({sql_list(KNOWN)}, model_a) is null or list_position({sql_list(KNOWN)}, model_b) is null group by all"""))
def pair_rejects(spark, sf):
    """Comparisons that canonical order rejects because they name a model outside the list, counted by pair."""
    return pw.reject_counts(fx.comparisons(spark, sf), KNOWN)


@query("pair_winrates", _q("""select noise, model, opponent, n, wins, round(wins / n, 6) winrate,
  round(1.96e0 * sqrt((wins / n) * (1 - wins / n) / n), 6) ci from oriented"""))
def pair_winrates(spark, sf):
    """A13 + A14: win-rates of every ordered pair with 95% half-widths."""
    return rounded(pw.pair_winrates(counts(spark, sf)))


_TIES = """t as (select noise, model, opponent, sum(ties) ties from (select noise, model_a model, model_b opponent, ties from counts
  union all select noise, model_b, model_a, ties from counts where model_a <> model_b) z group by all),
tg as (select g.noise, g.model, g.opponent, cast(coalesce(t.ties, 0) as bigint) ties from grid g
  left join t on t.noise = g.noise and t.model = g.model and t.opponent = g.opponent)"""


@query("pair_ties", _q("select * from tg", _GRID, _TIES))
def pair_ties(spark, sf):
    """Zero-filled symmetric tie matrix per noise."""
    return pw.pair_ties(counts(spark, sf), fx.CMP_MODELS)


@query("tie_increase", _q("""select model, opponent, ties_coupled, ties_independent,
  case when model = opponent then 0e0 else round(100 * (ties_coupled - ties_independent) / nullif(ties_independent, 0), 6) end increase
  from (select model, opponent, cast(sum(case when noise = 'Coupled' then ties end) as bigint) ties_coupled,
    cast(sum(case when noise = 'Independent' then ties end) as bigint) ties_independent from tg group by all) z""", _GRID, _TIES))
def tie_increase(spark, sf):
    """A16 + J10: relative tie increase, coupled vs independent."""
    return rounded(pw.tie_increase(pw.pair_ties(counts(spark, sf), fx.CMP_MODELS)))


_Z = f"""zt as (select model, opponent,
  cast(coalesce(sum(case when noise = 'Coupled' then n end), 0) as bigint) n_s,
  cast(coalesce(sum(case when noise = 'Coupled' then wins end), 0) as bigint) wins_s,
  cast(coalesce(sum(case when noise = 'Independent' then n end), 0) as bigint) n_d,
  cast(coalesce(sum(case when noise = 'Independent' then wins end), 0) as bigint) wins_d from oriented group by all),
zz as (select *, (wins_s / nullif(n_s, 0) - wins_d / nullif(n_d, 0)) / nullif(sqrt(((wins_s + wins_d) / (n_s + n_d))
   * (1 - (wins_s + wins_d) / (n_s + n_d)) * (1e0 / nullif(n_s, 0) + 1e0 / nullif(n_d, 0))), 0e0) z from zt)"""


@query("pair_ztest", _q(f"select model, opponent, n_s, wins_s, n_d, wins_d, round(z, 6) z, {significance_code_sql('z')} code from zz", _Z))
def pair_ztest(spark, sf):
    """A17 + P15 + J10: two-proportion z-test per ordered pair, significance code."""
    return rounded(pw.pair_ztest(counts(spark, sf)))


# p = 1 - erf(x), x = |z| / sqrt 2, by the series of positive terms
# erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum 2^n x^(2n+1) / (2n+1)!!  (p is 0 at 6 places beyond x = 6)
_P = """px as (select *, abs(z) / sqrt(2e0) x from zz),
pt as (select model, opponent, sum(exp(2 * n * ln(2e0) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2) - x * x)) s
  from px, (select cast(unnest(range(0, 250)) as double) n) k where x > 0 and x < 6 group by all),
pv as (select px.*, case when z is null then null when x >= 6 then 0e0 when x = 0 then 1e0 else 1 - 2 / sqrt(pi()) * s end p_value
  from px left join pt using (model, opponent))"""


@query("pair_pvalue", _q(f"select model, opponent, n_s, wins_s, n_d, wins_d, round(z, 6) z, {significance_code_sql('z')} code, "
                         "round(p_value, 6) p_value from pv", _Z, _P))
def pair_pvalue(spark, sf):
    """Z-test with its two-sided p-value (an Arrow UDF over erfc on the pair table)."""
    z = pw.pair_ztest(counts(spark, sf))
    return rounded(z.withColumn("p_value", p_value(F.col("z"))))


@query("side_rows", _q("""select noise, model_a model, mrank_a mrank, cast(winner = 'A' as int) win from canon
  union all select noise, model_b, mrank_b, cast(winner = 'B' as int) from canon"""))
def side_rows(spark, sf):
    """Two side rows per comparison."""
    return rk.side_rows(canon(spark, sf))


@query("avg_winrate", _q("select noise, model, mrank, cast(appearances as bigint) appearances, cast(wins as bigint) wins, round(theta, 6) theta from th", _TH))
def avg_winrate(spark, sf):
    """Average win-rate per model and noise."""
    return rounded(rk.avg_winrate(counts(spark, sf)))


@query("winrate_cov", _q("select noise, model_i, model_j, round(sigma, 12) sigma from sg", _TH, _SG))
def winrate_cov(spark, sf):
    """Covariance Sigma of the average win-rates (k x k per noise)."""
    _, sg = theta_sigma(spark, sf)
    return rounded(sg, 12)


@query("rank_sets", _q("select * from rs", _TH, _SG, _RS))
def rank_sets(spark, sf):
    """Rank-sets at alpha = 0.05 with the chi-square quantile for k models."""
    th, sg = theta_sigma(spark, sf)
    return rk.rank_sets(th, sg, K, ALPHA)


_LABELS = "[" + ",".join(f"'{x}'" for x in fx.CMP_LABELS) + "]"


@query("rank_table", _q(f"""select model, {_LABELS}[list_position({sql_list(fx.CMP_MODELS)}, model)] label,
  max(case when noise = 'Coupled' then rnk end) rank_coupled, max(case when noise = 'Coupled' then round(theta, 6) end) winrate_coupled,
  max(case when noise = 'Coupled' then ci end) ci_coupled,
  max(case when noise = 'Independent' then rnk end) rank_independent, max(case when noise = 'Independent' then round(theta, 6) end) winrate_independent,
  max(case when noise = 'Independent' then ci end) ci_independent
from (select th.noise, th.model, th.theta, round(1.96e0 * sqrt(sg.sigma), 4) ci,
        cast(rank() over (partition by th.noise order by rs.lo) as int) rnk
      from th join sg on sg.noise = th.noise and sg.model_i = th.model and sg.model_j = th.model
      join rs on rs.noise = th.noise and rs.model = th.model) z group by model""", _TH, _SG, _RS))
def rank_table(spark, sf):
    """A21 + P8 + P17: summary table with computed ranks, win-rates and intervals."""
    th, sg = theta_sigma(spark, sf)
    rs = rk.rank_sets(th, sg, K, ALPHA)
    return rounded(rk.rank_table(th, sg, rs, fx.CMP_MODELS, fx.CMP_LABELS))
