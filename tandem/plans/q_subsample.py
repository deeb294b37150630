"""Queries of the estimation-error study (FIXTURE F2), all subjects at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.hashing import MIX_P, mix_sql, poisson_weight_sql, row_seed_sql
from tandem.operators import subsample as ss
from tandem.plans.q_paired import PAIRS, pivot
from tandem.plans.q_scores import _q, scores
from tandem.plans.registry import query, rounded

GROUPS = ["subject", "noise"]
UNITS = ["qid", "rep"]
VALUES = [f"{a}_{b}" for a, b in PAIRS]
NAMES = {f"{a}_{b}": (a, b) for a, b in PAIRS}
SEED = 0
SUBJECT = "PROMO"
DRAWS = 1000
# The error levels marked in the reference: one subject with a level for every pair, four with one for the
# pair of the smaller models.
LEVELS = [("ECONOMY", "m8b", "m3b", 0.0373), ("ECONOMY", "m8b", "m1b", 0.0465), ("ECONOMY", "m3b", "m1b", 0.0341),
          ("LARGE", "m3b", "m1b", 0.0315), ("MEDIUM", "m3b", "m1b", 0.0374), ("PROMO", "m3b", "m1b", 0.00341),
          ("SMALL", "m3b", "m1b", 0.0335)]


def diff_wide(spark, sf):
    p = pivot(spark, sf)
    return p.select(*GROUPS, *UNITS, *[(F.col(a).cast("int") - F.col(b).cast("int")).alias(f"{a}_{b}") for a, b in PAIRS])


def errors(spark, sf, packed=False):
    return ss.subsample_error(diff_wide(spark, sf), VALUES, GROUPS, UNITS, seed=SEED, numerators=False, packed=packed)


def mean_long(spark, sf):
    m = ss.subsample_error(diff_wide(spark, sf), VALUES, GROUPS, UNITS, seed=SEED, reduce=True)
    arr = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"mean_{a}_{b}").alias("mean_err"))
                    for a, b in PAIRS])
    return m.select(*GROUPS, "n", "iterations", F.explode(arr).alias("p")) \
        .select(*GROUPS, "p.model_a", "p.model_b", "n", "iterations", "p.mean_err")


def errors_long(spark, sf):
    return ss.to_long(errors(spark, sf, packed=True), [*GROUPS, "iter", "n"], NAMES)


# Oracle: every (group, iteration) is one sorted list of integers that hold hash, rank of the unit and
# values; sums of 20 neighbours, then running sums of those, are the prefix sums.
_W = "w as materialized (select subject, noise, qid, rep, " + ", ".join(
    f"cast({a} as int) - cast({b} as int) {a}_{b}" for a, b in PAIRS) + " from piv)"
_ST = ("st as materialized (select *, row_number() over () gid from (select subject, noise, count(*) n_total, "
       + ", ".join(f"avg({v}) ref_{v}" for v in VALUES) + ", "
       + ", ".join(f"cast(sum({v}) as bigint) sum_{v}" for v in VALUES) + " from w group by all))")
_DIGITS = 4 ** len(VALUES)
_UNITS = 2 ** 20        # units of a group, at most, in the oracle
_E = f"""e0 as materialized (select gid, {row_seed_sql(str(SEED), 'w.subject', 'w.noise', 'w.qid', 'w.rep')} r,
  (row_number() over (partition by gid order by qid, rep) - 1) * {_DIGITS} + """ + " + ".join(
    f"({v} + 1) * {4 ** i}" for i, v in enumerate(VALUES)) + f""" tail from w join st using (subject, noise)),
ks as (select gid, iter, list_sort(list({mix_sql('r', 'iter')} * {_DIGITS * _UNITS} + tail)) ks
  from e0 cross join (select cast(unnest(range(0, {ss.ITERATIONS})) as int) iter) it group by gid, iter),
us as (select gid, iter, unnest(ks) k, generate_subscripts(ks, 1) pos from ks),
bs as (select gid, iter, cast((pos + {ss.STEP} - 1) // {ss.STEP} as bigint) b, """ + ", ".join(
    f"sum(k // {4 ** i} % 4 - 1) p_{v}" for i, v in enumerate(VALUES)) + f""" from us group by all),
ps as (select gid, iter, b * {ss.STEP} n, """ + ", ".join(f"cast(sum(p_{v}) over win as bigint) p_{v}" for v in VALUES) + """
  from bs window win as (partition by gid, iter order by b rows between unbounded preceding and current row)),
errs as (select subject, noise, iter, n, n * n_total den, """ + ", ".join(
    f"abs(sum_{v} * n - p_{v} * n_total) num_{v}" for v in VALUES) + ", " + ", ".join(
    f"abs(sum_{v} * n - p_{v} * n_total) / (n * n_total) err_{v}" for v in VALUES) + """
  from ps join st using (gid) where n < n_total),
el as (""" + " union all ".join(f"select subject, noise, iter, n, '{a}' model_a, '{b}' model_b, err_{a}_{b} err, num_{a}_{b} num, den from errs"
                                for a, b in PAIRS) + """),
em as (select subject, noise, model_a, model_b, n, count(*) iterations, sum(num) / (count(*) * any_value(den)) mean_err from el group by all)"""
_BOOT = f"""wd as (select d, i, ('0x' || substr(md5('{SEED}|boot|' || i), 1, 8))::bigint % {MIX_P} r
  from (select unnest(range(0, {DRAWS})) d), (select unnest(range(0, {ss.ITERATIONS})) i)),
wt as (select d, list(cast({poisson_weight_sql('r', 'd')} as double) order by i) wl from wd group by d),
ww as materialized (select wl, list_sum(wl) sw from wt where list_sum(wl) > 0),
pl as materialized (select subject, noise, model_a, model_b, n, any_value(den) den, count(*) iterations, sum(num) total, list(cast(num as double) order by iter) nl
  from el group by all),
bm as (select subject, noise, model_a, model_b, n, quantile_cont(list_inner_product(nl, wl) / (sw * den), [0.025, 0.975]) q from pl cross join ww group by all)"""
_LEVELS = "ls as (select * from (values " + ", ".join(
    f"('{s}', '{a}', '{b}', {x}e0)" for s, a, b, x in LEVELS) + ") v(subject, model_a, model_b, level))"


@query("subject_scores", _q(f"select * from sc where subject = '{SUBJECT}'"))
def subject_scores(spark, sf):
    """Scored replies of one subject."""
    return scores(spark, sf).filter(F.col("subject") == SUBJECT)


@query("ref_mean", _q("select subject, noise, n_total, " + ", ".join(f"round(ref_{v}, 6) ref_{v}" for v in VALUES)
                      + " from st", _W, _ST))
def ref_mean(spark, sf):
    """A10 + P10: full-sample mean difference per subject, noise and pair."""
    r = ss.reference_means(diff_wide(spark, sf), VALUES, GROUPS)
    return rounded(r.select(*GROUPS, "n_total", *[f"ref_{v}" for v in VALUES]))


@query("sub_error", _q("select subject, noise, iter, n, " + ", ".join(f"round(err_{v}, 6) err_{v}" for v in VALUES)
                       + " from errs", _W, _ST, _E))
def sub_error(spark, sf):
    """A11 + W3 + P16: 1000 nested random samples per subject and noise; error at n = 20, 40, ..."""
    e = errors(spark, sf)
    return rounded(e.select(*GROUPS, "iter", "n", *[f"err_{v}" for v in VALUES]))


@query("error_mean", _q("select subject, noise, model_a, model_b, n, iterations, round(mean_err, 6) mean_err from em",
                        _W, _ST, _E))
def error_mean(spark, sf):
    """A12 (centre): mean error over the iterations per subject, noise, pair and n (the
    iterations are summed inside each block of the error study)."""
    return rounded(mean_long(spark, sf))


@query("error_curve", _q("""select subject, noise, model_a, model_b, n, iterations, round(total / (iterations * den), 6) mean_err,
  round(q[1], 6) ci_lo, round(q[2], 6) ci_hi from bm join pl using (subject, noise, model_a, model_b, n)""", _W, _ST, _E, _BOOT))
def error_curve(spark, sf):
    """Mean error and 95% Poisson-bootstrap interval over the iterations."""
    return rounded(ss.error_curve(errors_long(spark, sf), [*GROUPS, "model_a", "model_b"], DRAWS, SEED))


@query("samples_needed", _q("""select subject, noise, model_a, model_b, level, min(case when mean_err <= level then n end) n_needed
  from em join ls using (subject, model_a, model_b) group by all""", _W, _ST, _E, _LEVELS))
def samples_needed(spark, sf):
    """Smallest sample size whose mean error is at most the level of its subject and pair."""
    keys = [*GROUPS, "model_a", "model_b"]
    levels = spark.createDataFrame(LEVELS, "subject string, model_a string, model_b string, level double")
    return ss.samples_needed(mean_long(spark, sf), keys, levels)
