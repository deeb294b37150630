"""Derived test inputs (FIXTURES.md part 3) built from the given parquet tables.

Each builder only produces rows in the schema an operator expects; none of them does
an operator's work. Every builder reads a whole table, so the work grows with it.
The DuckDB text of the same derivations lives in :mod:`tandem.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.hashing import uniform
from tandem.operators.indexing import ordinal
from tandem.sources.tables import spread, table

# ---- fixed values of the fixtures -------------------------------------------------
# Multiple-choice run seeds: coupled 72645763; independent 83475617 (8B), 29387482 (3B),
# 18987374 (1B). Skills are the fixture's invented accuracies.
COUPLED_SEED = 72645763
MC_MODELS = [  # (rank, model, skill, independent seed)
    (0, "m8b", 0.70, 83475617),
    (1, "m3b", 0.55, 29387482),
    (2, "m1b", 0.40, 18987374),
]
MC_MODEL_NAMES = [m[1] for m in MC_MODELS]
N_REPEATS = 10
DEV_KEYS = 40
# Pairwise fixture: six models with invented strengths; labels are the fixture's own.
CMP_STRENGTH = [0.40, 0.40, 0.38, 0.30, 0.29, 0.15]
CMP_MODELS = [f"model{i}" for i in range(len(CMP_STRENGTH))]
CMP_LABELS = [f"M{i}" for i in range(len(CMP_STRENGTH))]
# Vocabulary fixture: one "model" per language, in this rank order.
VOCAB_LANGS = ["en", "fr", "de", "es"]
# Token-stream fixture: end token and dropped special tokens.
STREAM_EOS = "error"
STREAM_SPECIAL = ["signup"]
# Logit fixture: number of models sharing the embedding rows.
LOGIT_MODELS = 3


def models_dim(spark: SparkSession, names, labels=None) -> DataFrame:
    """Model dimension (model, mrank, label): k rows, the order of ``names`` is the rank."""
    labels = labels or names
    rows = [(n, i, lab) for i, (n, lab) in enumerate(zip(names, labels))]
    return spark.createDataFrame(rows, "model string, mrank int, label string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multiple-choice questions; subjects are part types, the first ``DEV_KEYS`` keys are
    the dev set (as many at every scale: few-shot prompts hold all of a subject), all others test."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("qid"),
        F.col("p_type").alias("subject"),
        F.col("p_name").alias("question"),
        (F.col("p_size") % 4).cast("int").alias("answer"),
        F.array(*[F.concat(F.col("p_brand"), F.lit("-" + c)) for c in "ABCD"]).alias("choices"),
        (F.col("p_partkey") <= DEV_KEYS).alias("is_dev"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replies (model, seed, qid, rep, reply) of three models, two noises, ten repeats,
    for every test question. Replies carry every parser case."""
    q = spread(questions(spark, sf_dir).filter(~F.col("is_dev")).select("qid", "answer"), "qid")
    m = F.explode(F.array(*[
        F.struct(F.lit(r).alias("mrank"), F.lit(n).alias("model"), F.lit(s).alias("skill"),
                 F.lit(seed).cast("bigint").alias("iseed"))
        for r, n, s, seed in MC_MODELS]))
    r = (q.select("*", m.alias("m"))
         .select("qid", "answer", "m.*")
         .withColumn("noise", F.explode(F.array(F.lit("Coupled"), F.lit("Independent"))))
         .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(N_REPEATS - 1)))))
    coupled = F.col("noise") == "Coupled"
    u = F.when(coupled, uniform("'c'", "qid", "rep")).otherwise(uniform("'i'", "model", "qid", "rep"))
    right = F.expr("substr('ABCD', answer + 1, 1)")
    wrong = F.expr("substr('ABCD', (answer + 1) % 4 + 1, 1)")
    # Draws and letter are columns: written out in every branch they are computed again in each, and the generated code of the
    # stage gets too long for the JVM to compile.
    r = r.withColumns({"u": u, "st": uniform("'style'", "noise", "model", "qid", "rep")}) \
        .withColumn("letter", F.when(F.col("u") < F.col("skill"), right).otherwise(wrong))
    letter, st = F.col("letter"), F.col("st")
    reply = (F.when(st < 0.50, letter)
             .when(st < 0.60, F.concat(letter, F.lit(".")))
             .when(st < 0.70, F.concat(F.lit('"'), letter, F.lit('"')))
             .when(st < 0.80, F.concat(letter, F.lit(") because")))
             .when(st < 0.90, F.concat(letter, F.lit("\nsince")))
             .when(st < 0.94, F.concat(F.lit("The answer is "), letter))
             .when(st < 0.98, F.lower(letter)))
    seed = F.when(coupled, F.lit(COUPLED_SEED).cast("bigint")).otherwise(F.col("iseed"))
    return r.select("model", seed.alias("seed"), "qid", "rep", reply.alias("reply"))


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairwise judgements (noise, model_a, model_b, seed_a, seed_b, winner), one per
    lineitem row; orientation is random (not canonical)."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                         "l_linestatus"))
    k = len(CMP_STRENGTH)
    a = (F.col("l_suppkey") % k).cast("int")
    b = ((F.col("l_suppkey") + 1 + F.col("l_partkey") % (k - 1)) % k).cast("int")
    strength = F.array(*[F.lit(s) for s in CMP_STRENGTH])
    c = li.select(
        F.when(F.col("l_linestatus") == "F", "Coupled").otherwise("Independent").alias("noise"),
        a.alias("a"), b.alias("b"),
        F.col("l_orderkey").alias("seed_a"), F.col("l_linenumber").cast("bigint").alias("seed_b"),
        uniform("'cmp'", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("u"))
    sa = F.element_at(strength, F.col("a") + 1)
    sb = F.element_at(strength, F.col("b") + 1)
    eff = F.when(F.col("noise") == "Coupled", F.lit(0.015) * F.abs(F.col("b") - F.col("a"))).otherwise(F.lit(0.0))
    winner = (F.when(F.col("u") < F.lit(0.30) + (sa - sb) / 2 - eff, "A")
              .when(F.col("u") < F.lit(0.60) - 2 * eff, "B").otherwise("Tie"))
    return c.select("noise", F.concat(F.lit("model"), F.col("a").cast("string")).alias("model_a"),
                    F.concat(F.lit("model"), F.col("b").cast("string")).alias("model_b"),
                    "seed_a", "seed_b", winner.alias("winner"))


def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one vocabulary per language (mrank, model, token, token_id); ids follow byte order."""
    d = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1) \
        .when(F.col("lang") == "de", 2).otherwise(3)
    toks = (d.select(rank.alias("mrank"), F.col("lang").alias("model"),
                     F.explode(F.split(F.col("text"), " ")).alias("token"))
            .filter(F.col("token") != "").distinct())
    return ordinal(toks, ["mrank", "model"], ["token"], "token_id")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """next-token logits (mrank, unit, joint_id, logit); model m lacks the tokens with
    (pos + m) % 4 = 0, so vocabularies differ per model."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")) \
        .select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    mrank = (F.col("vec_id") % LOGIT_MODELS).cast("int")
    return (e.filter(((F.col("pos") + F.col("vec_id") % LOGIT_MODELS) % 4) != 0)
            .select(mrank.alias("mrank"), F.floor(F.col("vec_id") / LOGIT_MODELS).cast("bigint").alias("unit"),
                    F.col("pos").cast("int").alias("joint_id"), F.col("x").cast("double").alias("logit")))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 as one row per distribution: (mrank, unit, toks), ``toks`` an array of (joint_id, token_id,
    logit); a model's token ids number its own tokens."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    mrank = (F.col("vec_id") % LOGIT_MODELS).cast("int")
    cells = F.transform("embedding", lambda x, i: F.struct(i.alias("joint_id"), x.cast("double").alias("logit")))
    own = F.filter(cells, lambda t: (t["joint_id"] + F.col("vec_id") % LOGIT_MODELS) % 4 != 0)
    toks = F.transform(own, lambda t, i: F.struct(t["joint_id"].alias("joint_id"), i.alias("token_id"), t["logit"].alias("logit")))
    return e.select(mrank.alias("mrank"), F.floor(F.col("vec_id") / LOGIT_MODELS).cast("bigint").alias("unit"), toks.alias("toks"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token streams (unit, step, token): unit = user, token = event type in event order."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), "event_id",
                                                F.col("event_type").alias("token"))
    return ordinal(ev, ["unit"], ["event_id"], "step").select("unit", "step", "token")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns (conv_id, turn, question) of the conversations table."""
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "user") \
        .select("conv_id", "turn", F.col("text").alias("question"))


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """open questions (pos, conv_id, turn, question) = user turns in (conv_id, turn) order."""
    return ordinal(user_turns(spark, sf_dir), [], ["conv_id", "turn"], "pos")


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns (conv_id, turn, response) of the conversations table."""
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant") \
        .select("conv_id", "turn", F.col("text").alias("response"))
