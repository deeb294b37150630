"""Queries of the paired score analysis (FIXTURE F2): variance, covariance, medians."""

from __future__ import annotations

from tandem.operators import paired as pa
from tandem.operators import scoring as sc
from tandem.plans.q_scores import MODELS, _q, lowest_runs, scores, test_questions
from tandem.plans.oracle import F1, sql
from tandem.plans.registry import query, rounded

PAIRS = pa.ordered_pairs(MODELS)
CYCLIC = pa.cyclic_pairs(MODELS)


def pivot(spark, sf):
    return sc.noise_pivot(lowest_runs(spark, sf), MODELS, chosen=True)


def diffs(spark, sf, subject=None):
    return pa.pair_diffs(pivot(spark, sf), MODELS, subject)


PD = "pd as (" + " union all ".join(
    f"select noise, subject, qid, rep, '{a}' model_a, '{b}' model_b, cast({a} as int) - cast({b} as int) diff from piv"
    for a, b in PAIRS) + ")"
MV = "mv as (select noise, subject, qid, model_a, model_b, var_samp(diff) var from pd group by all)"
VP = """vp as (select subject, qid, model_a, model_b, max(case when noise = 'Coupled' then var end) coupled,
  max(case when noise = 'Independent' then var end) independent from mv group by all)"""
CP = "cp as (" + " union all ".join(
    f"select noise, subject, qid, rep, '{a}' model_a, '{b}' model_b, cast({a} as int) ok_a, cast({b} as int) ok_b "
    f"from piv where noise = 'Coupled'" for a, b in CYCLIC) + ")"
CV = "cv as (select subject, qid, model_a, model_b, covar_samp(cast(ok_a as double), cast(ok_b as double)) cov from cp group by all)"


@query("pair_diff", _q("select * from pd", PD))
def pair_diff(spark, sf):
    """J5 + P18: per-repeat score differences of every ordered model pair."""
    return diffs(spark, sf)


@query("diff_var", _q("select noise, subject, qid, model_a, model_b, round(var, 6) var from mv", PD, MV))
def diff_var(spark, sf):
    """A5: variance (ddof 1) of the difference per question and noise."""
    return rounded(pa.metric_per_question(diffs(spark, sf), "var"))


@query("diff_mean", _q("select noise, subject, qid, model_a, model_b, round(avg(diff), 6) mean from pd group by all", PD))
def diff_mean(spark, sf):
    """A6 + U3: a named metric (mean) of the difference per question and noise."""
    return rounded(pa.metric_per_question(diffs(spark, sf), "mean"))


@query("var_pivot", _q("select subject, qid, model_a, model_b, round(coupled, 6) coupled, round(independent, 6) independent from vp",
                       PD, MV, VP))
def var_pivot(spark, sf):
    """Per-question variances, one column per noise."""
    return rounded(pa.pivot_noise(pa.metric_per_question(diffs(spark, sf), "var"), "var"))


@query("var_median", _q("select noise, subject, model_a, model_b, round(median(var), 6) median from mv where var is not null group by all",
                        PD, MV))
def var_median(spark, sf):
    """Exact median of the per-question variances per (noise, subject, pair)."""
    mv = pa.metric_per_question(diffs(spark, sf), "var")
    return rounded(pa.exact_median(mv, ["noise", "subject", "model_a", "model_b"], "var"))


@query("cyclic_pairs", _q("select * from cp", CP))
def q_cyclic_pairs(spark, sf):
    """Coupled results of the cyclic model pairs (m0,m1), (m1,m2), (m2,m0)."""
    return pa.paired_rows(pivot(spark, sf), CYCLIC)


@query("score_cov", _q("select subject, qid, model_a, model_b, round(cov, 6) cov from cv", CP, CV))
def score_cov(spark, sf):
    """Covariance of the two models' correctness per question (coupled)."""
    return rounded(pa.question_cov(pa.paired_rows(pivot(spark, sf), CYCLIC)))


@query("cov_mean", _q("select subject, model_a, model_b, round(avg(cov), 6) cov_mean from cv group by all", CP, CV))
def cov_mean(spark, sf):
    """Mean covariance per (subject, pair)."""
    from pyspark.sql import functions as F
    cov = pa.question_cov(pa.paired_rows(pivot(spark, sf), CYCLIC))
    return rounded(cov.groupBy("subject", "model_a", "model_b").agg(F.avg("cov").alias("cov_mean")))


@query("question_no", sql("select subject, qid, dense_rank() over (partition by subject order by qid) - 1 question_no "
                          "from (select distinct subject, qid from f1 where not is_dev) z", ("f1", F1)))
def question_no(spark, sf):
    """Question number inside its subject."""
    return pa.question_numbers(test_questions(spark, sf))
