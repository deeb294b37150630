"""Queries over multiple-choice replies (FIXTURES F1 + F2): scoring, E2 ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.parsing import parse_choice, parse_choice_sql
from tandem.operators import scoring as sc
from tandem.operators.pairwise import NOISES
from tandem.plans.oracle import F1, F2, sql
from tandem.plans.registry import query, rounded
from tandem.sources import fixtures as fx

MODELS = fx.MC_MODEL_NAMES
R = fx.N_REPEATS
CS = fx.COUPLED_SEED


def test_questions(spark, sf):
    return fx.questions(spark, sf).filter(~F.col("is_dev"))


def scores(spark, sf):
    return sc.score(fx.replies(spark, sf), test_questions(spark, sf), CS, R)


def lowest_runs(spark, sf):
    return sc.lowest_runs(fx.replies(spark, sf), test_questions(spark, sf), CS, R)


SCORED = f"""q as (select qid, subject, case when answer between 0 and 3 then substr('ABCD', answer + 1, 1) end correct
  from f1 where not is_dev),
runs as (select model, seed, count(*) n_rows from f2 group by all),
ok_runs as (select model, seed from runs where n_rows = (select count(*) * {R} from q)),
scored as (select case when r.seed = {CS} then 'Coupled' else 'Independent' end noise, r.model, r.seed, q.subject,
   r.qid, r.rep, {parse_choice_sql('r.reply')} choice, q.correct
  from f2 r semi join ok_runs using (model, seed) join q on q.qid = r.qid where q.correct is not null),
sc as (select *, choice = correct ok from scored),
fs as (select sc.* from sc semi join (select noise, model, min(seed) seed from sc group by all) m using (noise, model, seed)),
piv as (select noise, subject, qid, rep, {", ".join(f"max(case when model = '{m}' then ok end) {m}" for m in MODELS)}
  from fs group by all)"""


def _q(body: str, *more: str) -> str:
    return sql(body, ("f1", F1), ("f2", F2), raw=",\n".join([SCORED, *more]))


@query("parse_choice", sql(f"select model, seed, qid, rep, reply, {parse_choice_sql('reply')} choice from f2", ("f2", F2)))
def q_parse_choice(spark, sf):
    """P1 + U1: the letter parsed from every reply."""
    r = fx.replies(spark, sf)
    return r.withColumn("choice", parse_choice("reply"))


@query("score_rows", _q("select * from sc"))
def score_rows(spark, sf):
    """P2 + P5 + J2 + J3 + J4 + U1: scored replies with subject and noise."""
    return scores(spark, sf)


@query("accuracy", _q("select noise, model, subject, count(*) n, round(avg(cast(ok as int)), 6) accuracy from sc group by all"))
def q_accuracy(spark, sf):
    """A3 + P5: accuracy per noise, model and subject."""
    return rounded(sc.accuracy(scores(spark, sf)))


@query("noise_pivot", _q("select * from piv"))
def q_noise_pivot(spark, sf):
    """A4: noise x model pivot of correctness (lowest seed per noise and model)."""
    return sc.noise_pivot(lowest_runs(spark, sf), MODELS, chosen=True)


@query("subjects", sql("select distinct subject from f1 where not is_dev", ("f1", F1)))
def q_subjects(spark, sf):
    """Distinct subjects."""
    return sc.subjects(test_questions(spark, sf))


@query("noise_stack", sql(f"""select n.noise, q.qid, q.subject, cast(r.rep as int) rep from (select * from f1 where not is_dev) q,
  (select unnest(['Coupled','Independent']) noise) n, (select unnest(range(0, {R})) rep) r""", ("f1", F1)))
def q_noise_stack(spark, sf):
    """T4: subjects stacked once per noise and repeat."""
    return sc.noise_stack(test_questions(spark, sf), R, NOISES)


@query("parallel_explode", _q("select * from piv"))
def q_parallel_explode(spark, sf):
    """T5: per-question result lists of all models exploded in lock-step."""
    wide = sc.noise_lists(scores(spark, sf), MODELS)
    return sc.parallel_explode(wide, MODELS).select("noise", "subject", "qid", "rep", *MODELS)
