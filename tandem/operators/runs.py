"""Run plans: repeats, chunks, per-row seeds and the model x run schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.hashing import seed_in_range
from tandem.operators.indexing import ordinal

# ---- fixed values of the reference's runs ---------------------------------------------
PROMPT_SEED_RANGE = (2 ** 24, 2 ** 32)             # per (question, repeat) seed, multiple choice
QUESTION_SEED_RANGE = (10000000, 99999999)         # per question seed, open questions
COUPLED_BASE_SEED = 500000                          # base seed shared by all models (coupled)
RUNS_PER_MODEL = 10


def repeat_rows(df: DataFrame, n_repeats: int) -> DataFrame:
    """Every row ``n_repeats`` times, numbered by ``rep``."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep"))


def positions(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Explicit 0-based row position by ``order`` (replaces implicit row order)."""
    return ordinal(df, [], order, name)


def chunk(df: DataFrame, chunk_size: int, chunk_idx: int, order: Sequence[str] = ("qid",),
          strict: bool = False) -> DataFrame:
    """R2 + S3: rows at positions [idx * size, min((idx + 1) * size, len)); ``chunk_idx = -1``
    keeps everything. ``strict`` restores the reference's check idx < len // size (which
    makes a partial last chunk unreachable)."""
    p = positions(df, order)
    if chunk_idx == -1:
        return p
    if strict:
        n = df.count()
        if not chunk_idx < n // chunk_size:
            raise ValueError("Chunk index is out of range")
    start = chunk_idx * chunk_size
    return p.filter((F.col("pos") >= start) & (F.col("pos") < start + chunk_size))


def row_seeds(df: DataFrame, run_seed: int, keys: Sequence[str] = ("qid", "rep"),
              seed_range: tuple[int, int] = PROMPT_SEED_RANGE) -> DataFrame:
    """A seed in ``seed_range`` per row, keyed by the run seed and the row keys."""
    return df.withColumn("seed", seed_in_range(seed_range[0], seed_range[1], F.lit(run_seed), *keys))


def run_schedule(models: Sequence[tuple[str, int, int]], n_runs: int = RUNS_PER_MODEL,
                 coupled_base: int = COUPLED_BASE_SEED):
    """R5 + S9 as a column generator: for each (model, quantisation, independent base seed)
    and noise, runs 1..n with seed base + run - 1 and the run file name."""
    entries = []
    for model, quant, base in models:
        for noise, b in (("Coupled", coupled_base), ("Independent", base)):
            entries.append(F.struct(F.lit(model).alias("model"), F.lit(quant).alias("quant"),
                                    F.lit(noise).alias("noise"), F.lit(b).alias("base_seed")))
    return F.explode(F.array(*entries)).alias("m"), F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run")


def run_plan(questions: DataFrame, models: Sequence[tuple[str, int, int]], n_runs: int = RUNS_PER_MODEL,
             coupled_base: int = COUPLED_BASE_SEED) -> DataFrame:
    """R5 + S9 + R4: every (model, noise, run, question position) with its seeds and run name.

    ``questions`` must carry ``pos``. The schedule is generated from the model list by
    array explosion (no cross join); each question's seed is keyed by the run seed."""
    m, run = run_schedule(models, n_runs, coupled_base)
    plan = questions.select("pos", m, run).select("pos", "m.*", "run")
    run_seed = (F.col("base_seed") + F.col("run") - 1).cast("bigint")
    name = F.concat(F.when(F.col("base_seed") == coupled_base, F.lit("responses_shared_"))
                    .otherwise(F.lit("responses_different_")), F.col("run").cast("string"))
    lo, hi = QUESTION_SEED_RANGE
    return plan.select("model", "quant", "noise", "run", run_seed.alias("run_seed"), name.alias("name"), "pos") \
        .withColumn("seed", seed_in_range(lo, hi, F.col("run_seed"), "pos"))


def first_row(df: DataFrame, order: Sequence[str], pos: str = "pos") -> DataFrame:
    """The first row by ``order`` only (debug head), with its position 0: one aggregate that keeps a row a task, no sort.
    Nulls come first; equal keys go by the whole row. A table without rows gives none."""
    row = F.struct(*df.columns)
    least = df.agg(F.min(F.struct(F.struct(*order).alias("key"), row.alias("row"))).alias("m")).filter("m is not null")
    return least.select("m.row.*").withColumn(pos, F.lit(0).cast("bigint"))
