"""Sampling queries (FIXTURE F5 logits, F7 token streams, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.hashing import seed_in_range
from tandem.functions.hashing import uniform_sql as U
from tandem.operators import sampling as sa
from tandem.plans.oracle import F5, F6, F7, sql
from tandem.plans.registry import query, rounded
from tandem.sources import fixtures as fx

# ---- fixed values: multiple-choice run settings of the reference's script ------------
TEMPERATURE = 0.7
MAX_LENGTH = 20
RUN_SEED = 42
SEED_LO, SEED_HI = 2 ** 24, 2 ** 32            # per-prompt seeds of multiple-choice runs
OPEN_SEED_LO, OPEN_SEED_HI = 10000000, 99999999  # per-question seeds of open-question runs
OPEN_BASE_SEED = 500000


def _seed_sql(lo, hi, *keys):
    return f"cast({lo} + floor({U(*keys)} * {float(hi - lo)!r}) as bigint)"


def logits(spark, sf):
    return fx.logits(spark, sf).select("unit", F.lit(0).alias("step"), F.col("mrank").alias("model"), "joint_id", "logit")


def probs(spark, sf):
    return sa.softmax(logits(spark, sf), TEMPERATURE)


def dists(spark, sf):
    d = fx.distributions(spark, sf).select("unit", F.lit(0).alias("step"), F.col("mrank").alias("model"), "toks")
    return sa.softmax_arrays(d, TEMPERATURE)


def coupled_seeds(df):
    return df.select("unit").distinct().withColumn("seed", seed_in_range(SEED_LO, SEED_HI, F.lit(RUN_SEED), "unit"))


def independent_seeds(df):
    return df.select("unit", "model").distinct().withColumn(
        "seed", seed_in_range(SEED_LO, SEED_HI, F.lit(RUN_SEED), "model", "unit"))


LG = """lg as (select unit, 0 step, mrank model, joint_id, logit,
  row_number() over (partition by mrank, unit order by joint_id) - 1 token_id from f5)"""
SM = """sm as (select *, exp(logit / 0.7e0 - max(logit / 0.7e0) over w) e from lg window w as (partition by unit, step, model)),
pr as (select unit, step, model, joint_id, token_id, logit, e / sum(e) over (partition by unit, step, model) p from sm)"""
CS = f"cs as (select distinct unit, {_seed_sql(SEED_LO, SEED_HI, str(RUN_SEED), 'unit')} seed from lg)"
IS = f"isd as (select distinct unit, model, {_seed_sql(SEED_LO, SEED_HI, str(RUN_SEED), 'model', 'unit')} seed from lg)"


def _draw_sql(seeds: str, on: str) -> str:
    g = f"-ln(-ln({U('s.seed', 'pr.step', 'pr.joint_id')} + 1e-20) + 1e-20)"
    return f"""select unit, step, model, cast(joint_id as int) joint_id, cast(token_id as int) token_id from (select pr.unit, pr.step, pr.model, pr.joint_id, pr.token_id,
  row_number() over (partition by pr.unit, pr.step, pr.model order by ln(pr.p + 1e-20) + {g} desc, pr.joint_id) rn
  from pr join {seeds} s using ({on})) z where rn = 1"""


@query("softmax", sql("select unit, step, model, joint_id, round(logit, 12) logit, round(p, 12) p from pr", ("f5", F5), raw=",\n".join([LG, SM])))
def q_softmax(spark, sf):
    """P11 + W4: temperature softmax per (unit, step, model), row by row."""
    # the outer form: below a plain explode the planner puts a filter that computes every distribution again
    t = dists(spark, sf).select("unit", "step", "model", F.explode_outer("toks").alias("t")).where("t is not null")
    return rounded(t.select("unit", "step", "model", "t.joint_id", "t.logit", "t.p"), 12)


@query("gumbel", sql(f"""select unit, step, joint_id, seed, u, round(-ln(-ln(u + 1e-20) + 1e-20), 9) g from (
  select distinct lg.unit, lg.step, lg.joint_id, cs.seed, {U('cs.seed', 'lg.step', 'lg.joint_id')} u from lg join cs using (unit)) z""",
                     ("f5", F5), raw=",\n".join([LG, CS])))
def q_gumbel(spark, sf):
    """P12 + R6: keyed uniform and Gumbel noise per (unit seed, step, joint id)."""
    lg = logits(spark, sf)
    rows = lg.select("unit", "step", "joint_id").distinct().join(coupled_seeds(lg), "unit")
    n = sa.noise(rows)
    return rounded(n, 12, g=9, u=None)


@query("coupled_draw", sql(_draw_sql("cs", "unit"), ("f5", F5), raw=",\n".join([LG, SM, CS])))
def coupled_draw(spark, sf):
    """A22 + J8 + J6: Gumbel-max draw with noise shared by all models (one seed per unit)."""
    return sa.draw_arrays(dists(spark, sf).withColumn("seed", seed_in_range(SEED_LO, SEED_HI, F.lit(RUN_SEED), "unit")))


@query("independent_draw", sql(_draw_sql("isd", "unit, model"), ("f5", F5), raw=",\n".join([LG, SM, IS])))
def independent_draw(spark, sf):
    """A22 + J6: Gumbel-max draw with one seed per (unit, model)."""
    return sa.draw_arrays(dists(spark, sf).withColumn("seed", seed_in_range(SEED_LO, SEED_HI, F.lit(RUN_SEED), "model", "unit")))


@query("eos_cut", sql(f"""select f7.unit, f7.step, f7.token from f7 join (select unit, min(case when token = '{fx.STREAM_EOS}' then step end) es
  from f7 group by unit) e using (unit) where e.es is null or f7.step < e.es""", ("f7", F7)))
def eos_cut(spark, sf):
    """Token streams cut before the first end token."""
    return sa.eos_cut(fx.token_streams(spark, sf), fx.STREAM_EOS)


_SPECIAL = ",".join(f"'{t}'" for t in [fx.STREAM_EOS, *fx.STREAM_SPECIAL])


@query("reply_text", sql(f"""select unit, cast(count(case when keep then 1 end) as int) n_tokens,
  coalesce(string_agg(case when keep then token end, ' ' order by step), '') text
from (select *, step < {MAX_LENGTH} and step < coalesce(min(case when token = '{fx.STREAM_EOS}' then step end) over (partition by unit), {MAX_LENGTH})
        and token not in ({_SPECIAL}) keep from f7) z
group by unit""", ("f7", F7)))
def reply_text(spark, sf):
    """Reply text per unit (step order, stop at end token or max length, specials dropped)."""
    return sa.reply_text(fx.token_streams(spark, sf), fx.STREAM_EOS, MAX_LENGTH, fx.STREAM_SPECIAL)


@query("result_rows", sql(f"""select f6.question, 'assistant' model, a.text response,
  {_seed_sql(OPEN_SEED_LO, OPEN_SEED_HI, str(OPEN_BASE_SEED), 'f6.pos')} seed
from f6 left join conversations a on a.conv_id = f6.conv_id and a.turn = f6.turn + 1 and a.role = 'assistant'""", ("f6", F6)))
def result_rows(spark, sf):
    """P14 (+ R4): result rows (question, model, response, seed) of an open-question run, one for every
    question (null response where there is none)."""
    q = fx.open_questions(spark, sf)
    a = fx.assistant_turns(spark, sf).withColumnRenamed("turn", "a_turn")
    j = q.join(a, (q.conv_id == a.conv_id) & (a.a_turn == q.turn + 1), "left")
    return j.select("question", F.lit("assistant").alias("model"), "response",
                    seed_in_range(OPEN_SEED_LO, OPEN_SEED_HI, F.lit(OPEN_BASE_SEED), "pos").alias("seed"))
