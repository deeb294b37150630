"""Run-plan and prompt queries (FIXTURE F1 questions, F6 open questions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.hashing import uniform_sql as U
from tandem.operators import prompts as pr
from tandem.operators import runs as ru
from tandem.plans.oracle import F1, F6, sql
from tandem.plans.registry import query
from tandem.sources import fixtures as fx

R = fx.N_REPEATS
RUN_SEED = 42
CHUNK_SIZE, CHUNK_IDX = 250, 0          # reference defaults
FEW_SHOT = 5
# Open-question run schedule: (model, quantisation, independent base seed); the coupled
# base seed 500000 is shared. Fixed values of the reference's run script, with the
# fixture's model names.
OPEN_MODELS = [("m8b", 0, 200000), ("m3b", 0, 300000), ("m1b", 0, 400000), ("m8b", 4, 800000), ("m8b", 8, 700000)]


def _seed_sql(lo, hi, *keys):
    return f"cast({lo} + floor({U(*keys)} * {float(hi - lo)!r}) as bigint)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def test_q(spark, sf):
    return fx.questions(spark, sf).filter(~F.col("is_dev"))


def dev_q(spark, sf):
    return fx.questions(spark, sf).filter(F.col("is_dev"))


TQ = "tq as (select * from f1 where not is_dev)"
BLOCK = ("question || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3]"
         " || chr(10) || 'D. ' || choices[4] || chr(10) || 'Answer:'")
_HEAD0, _HEAD1 = pr.FEW_SHOT_HEADER.split("{subject}")
HEADER = f"{_lit(_HEAD0)} || replace(subject, '_', ' ') || {_lit(_HEAD1)}"
SHOTS = f"""shots as (select subject, {HEADER} || string_agg({BLOCK} || substr('ABCD', answer + 1, 1) || chr(10) || chr(10), '' order by qid) shots
  from f1 where is_dev group by subject),
fq as (select tq.qid, tq.subject, {BLOCK.replace('question', 'tq.question').replace('choices', 'tq.choices')} block,
  coalesce(shots.shots, {HEADER.replace('subject', 'tq.subject')}) shots from tq left join shots using (subject))"""


@query("repeat_rows", sql(f"select qid, subject, cast(unnest(range(0, {R})) as int) rep from tq", ("f1", F1), raw=TQ))
def repeat_rows(spark, sf):
    """Every test question repeated (adjacent copies numbered by rep)."""
    return ru.repeat_rows(test_q(spark, sf).select("qid", "subject"), R)


@query("chunk", sql(f"""select * from (select row_number() over (order by qid) - 1 pos, qid, subject from tq) z
  where pos >= {CHUNK_IDX * CHUNK_SIZE} and pos < {(CHUNK_IDX + 1) * CHUNK_SIZE}""", ("f1", F1), raw=TQ))
def q_chunk(spark, sf):
    """R2 + S3 + W5: one chunk of the question set by position (size 250, index 0)."""
    return ru.chunk(test_q(spark, sf).select("qid", "subject"), CHUNK_SIZE, CHUNK_IDX).select("pos", "qid", "subject")


@query("row_seeds", sql(f"""select qid, rep, {_seed_sql(2 ** 24, 2 ** 32, str(RUN_SEED), 'qid', 'rep')} seed
  from (select qid, cast(unnest(range(0, {R})) as int) rep from tq) z""", ("f1", F1), raw=TQ))
def row_seeds(spark, sf):
    """Seed in [2^24, 2^32) per (question, repeat) of a run."""
    return ru.row_seeds(ru.repeat_rows(test_q(spark, sf).select("qid"), R), RUN_SEED)


@query("pos_seeds", sql(f"select pos, {_seed_sql(10000000, 99999999, '500000', 'pos')} seed from f6", ("f6", F6)))
def pos_seeds(spark, sf):
    """R4 + W5: seed in [10^7, 99999999) per open-question position (base seed 500000)."""
    return ru.row_seeds(fx.open_questions(spark, sf).select("pos"), ru.COUPLED_BASE_SEED, ["pos"],
                        ru.QUESTION_SEED_RANGE)


_SCHED = ", ".join(f"('{m}', {q}, '{n}', {b})" for m, q, base in OPEN_MODELS
                   for n, b in (("Coupled", ru.COUPLED_BASE_SEED), ("Independent", base)))


@query("run_plan", sql(f"""select model, quant, noise, run, run_seed,
  case when base_seed = {ru.COUPLED_BASE_SEED} then 'responses_shared_' else 'responses_different_' end || run name, pos,
  {_seed_sql(10000000, 99999999, 'run_seed', 'pos')} seed
from (select s.*, r.run, cast(s.base_seed + r.run - 1 as bigint) run_seed, f6.pos from f6,
  (select * from (values {_SCHED}) v(model, quant, noise, base_seed)) s,
  (select cast(unnest(range(1, {ru.RUNS_PER_MODEL + 1})) as int) run) r) z""", ("f6", F6)))
def run_plan(spark, sf):
    """R5 + S9 + R4: open-question runs of every model, noise and run with per-question seeds."""
    return ru.run_plan(fx.open_questions(spark, sf), OPEN_MODELS)


@query("zero_shot", sql(f"select qid, {BLOCK} query, {_lit(pr.DEFAULT_SYSTEM)} system from tq", ("f1", F1), raw=TQ))
def zero_shot(spark, sf):
    """P4 + U2: zero-shot prompts with the default system prompt."""
    return pr.prompts("mmlu", test_q(spark, sf))


@query("open_prompts", sql(f"select pos, question query, {_lit(pr.OPEN_SYSTEM)} system from f6", ("f6", F6)))
def open_prompts(spark, sf):
    """Prompts of the open questions by their own formatter."""
    return pr.prompts("lmsys", fx.open_questions(spark, sf))


@query("few_shot", sql(f"select qid, shots || block query, {_lit(pr.DEFAULT_SYSTEM)} system from fq", ("f1", F1),
                       raw=",\n".join([TQ, SHOTS])))
def few_shot(spark, sf):
    """P6 + J1 + A28 + P3: few-shot prompts with all dev examples of the subject."""
    return pr.prompts("mmlu", test_q(spark, sf), dev=dev_q(spark, sf), few_shot=FEW_SHOT)


@query("few_shot_system", sql(f"select qid, block query, shots || {_lit(pr.FEW_SHOT_INSTRUCTION)} system from fq",
                              ("f1", F1), raw=",\n".join([TQ, SHOTS])))
def few_shot_system(spark, sf):
    """Few-shot examples and instruction moved into the system prompt."""
    return pr.format_prompts(test_q(spark, sf), dev_q(spark, sf), few_shot=FEW_SHOT, few_shot_system=True)


@query("chat_messages", sql(f"""select qid, 1 msg_no, 'system' role, {_lit(pr.DEFAULT_SYSTEM)} content from tq
  union all select qid, 2, 'user', {BLOCK} from tq""", ("f1", F1), raw=TQ))
def chat_messages(spark, sf):
    """(system, user) chat of every zero-shot prompt, one row per message."""
    c = pr.chat_messages(pr.format_prompts(test_q(spark, sf)))
    return c.select("qid", F.posexplode("chat").alias("i", "m")).select(
        "qid", (F.col("i") + 1).alias("msg_no"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))
