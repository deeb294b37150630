"""Scoring of multiple-choice replies (E2 ingest): J2-J4, A3, A4, T3-T5, U1.

The long score table (noise, model, seed, subject, qid, rep, ok) replaces the
reference's nested dict of per-file boolean lists; explicit (qid, rep) keys replace
row positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.parsing import noise_label, parse_choice, parse_correct
from tandem.operators.indexing import ordinal
from tandem.session import write_once


def length_guard(replies: DataFrame, questions: DataFrame, n_repeats: int,
                 file: Sequence[str] = ("model", "seed")) -> DataFrame:
    """Rows of every run file against questions x repeats.

    ``file`` names the columns that tell files apart (a table without files has one per run).
    ``replies`` may also be a table of files with their ``n_rows`` (as a scan of a reply tree gives), which is
    not counted again. The reference silently drops a file whose length differs; here every file is
    reported with ``accepted`` so dropped ones are visible."""
    expected = questions.select((F.count(F.lit(1)) * F.lit(n_repeats)).cast("bigint")).scalar()
    files = replies.select(*file, F.col("n_rows").cast("bigint").alias("n_rows")) if "n_rows" in replies.columns and "reply" not in replies.columns \
        else replies.groupBy(*file).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return files.withColumn("expected", expected).withColumn("accepted", F.col("n_rows") == F.col("expected"))


def head_questions(questions: DataFrame, n_samples: int | None, order: Sequence[str] = ("qid",)) -> DataFrame:
    """S3 + W5: questions with their position ``qpos`` by ``order``; the first ``n_samples`` of them."""
    q = ordinal(questions, [], order, "qpos")
    return q if n_samples is None else q.filter(F.col("qpos") < n_samples)


def accepted_files(files: DataFrame, questions: DataFrame, n_repeats: int) -> DataFrame:
    """J3 + T4: the files of a reply tree (:class:`tandem.sources.files.ReplyTree`) that hold questions x repeats rows,
    with their number ``nth`` in path order inside the (model, seed) run. Reads the file table only."""
    good = files.join(length_guard(files, questions, n_repeats, ["path"]).filter("accepted").select("path"), "path", "left_semi")
    # files of one run: a few rows
    return good.withColumn("nth", F.row_number().over(Window.partitionBy("model", "seed").orderBy("path")) - 1)


def tree_replies(tree: DataFrame, questions: DataFrame, n_repeats: int, n_samples: int | None = None) -> DataFrame:
    """S1 -> J2: rows of a scanned reply tree with their keys (model, seed, qid, rep, reply).

    A file's rows are the questions in order, each ``n_repeats`` times in adjacent copies. Files of
    another length contribute nothing (J3, per file); several accepted files of one (model, seed)
    are appended in path order (T4), their repeats counted on. A tree scanned with :func:`accepted_files`
    brings the number ``nth`` along and is read once; any other tree is read a second time for it."""
    q = head_questions(questions, n_samples)
    if "nth" not in tree.columns:
        rest = ["model", "seed", "path"]
        files = tree.select(*rest, "n_rows").distinct() if "n_rows" in tree.columns else tree.groupBy(*rest).agg(F.count(F.lit(1)).alias("n_rows"))
        good = accepted_files(files, q, n_repeats).select(F.col("path").alias("_path"), "nth")
        tree = tree.join(good, F.col("path") == F.col("_path"))
    rows = tree.select("model", "seed", F.floor(F.col("pos") / n_repeats).alias("qpos"),
                       (F.col("nth") * n_repeats + F.col("pos") % n_repeats).cast("int").alias("rep"), "reply")
    return rows.join(q.select("qpos", "qid"), "qpos").select("model", "seed", "qid", "rep", "reply")


def score(replies: DataFrame, questions: DataFrame, coupled_seed: int, n_repeats: int,
          parse_reply: Callable[[Column], Column] = parse_choice,
          parse_answer: Callable[[Column], Column] = parse_correct,
          n_samples: int | None = None, guard: bool = True) -> DataFrame:
    """P1 + P2 + P5 + J2 + J3 + J4 + U1: one row per reply with its correctness.

    ``questions`` (qid, subject, answer) is the test split; ``n_samples`` keeps the
    first n questions in order of qid (S3). With ``guard``, (model, seed) runs of another length are
    excluded (replies from files are guarded by :func:`tree_replies`); answers outside 0..3
    are rejected (inner join on a non-null correct letter). Scanned trees have string seeds.
    Output: noise, model, seed, subject, qid, rep, choice, correct, ok.
    """
    q = questions if n_samples is None else head_questions(questions, n_samples)
    q = q.select("qid", "subject", parse_answer(F.col("answer")).alias("correct"))
    r = replies
    if guard:
        ok_runs = length_guard(replies, q, n_repeats).filter("accepted").select("model", "seed")
        r = r.join(ok_runs, ["model", "seed"], "left_semi")
    s = r.join(q.filter(F.col("correct").isNotNull()), "qid")
    choice = parse_reply(F.col("reply"))
    return s.select(noise_label("seed", coupled_seed).alias("noise"), "model", "seed", "subject", "qid", "rep",
                    choice.alias("choice"), "correct", (choice == F.col("correct")).alias("ok"))


def accuracy(scores: DataFrame) -> DataFrame:
    """A3: mean accuracy per (noise, model, subject)."""
    return scores.groupBy("noise", "model", "subject").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(F.col("ok").cast("int")).alias("accuracy"))


def first_seed(scores: DataFrame) -> DataFrame:
    """A4 seed choice: per (noise, model) keep only the lowest seed's rows."""
    chosen = scores.groupBy("noise", "model").agg(F.min("seed").alias("seed"))
    return scores.join(F.broadcast(chosen), ["noise", "model", "seed"], "left_semi")


def lowest_runs(replies: DataFrame, questions: DataFrame, coupled_seed: int, n_repeats: int,
                parse_reply: Callable[[Column], Column] = parse_choice,
                parse_answer: Callable[[Column], Column] = parse_correct) -> DataFrame:
    """A4 from replies: the scores (noise, model, seed, subject, qid, rep, ok) of the lowest accepted seed per (noise, model);
    what :func:`score` and :func:`first_seed` give, from one pass over the replies.

    The pass scores all rows and writes them once; row counts (J3) and seeds are then one aggregate over three
    columns of that table, and the rows to keep a scan of it filtered by the few runs chosen."""
    q = questions.select("qid", "subject", parse_answer(F.col("answer")).alias("correct"))
    expected = questions.select((F.count(F.lit(1)) * F.lit(n_repeats)).cast("bigint")).scalar()
    scored = write_once(replies.join(q, "qid", "left").select(
        noise_label("seed", coupled_seed).alias("noise"), "model", "seed", "subject", "qid", "rep",
        (parse_reply(F.col("reply")) == F.col("correct")).alias("ok")))
    runs = scored.groupBy("noise", "model", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.count("ok").alias("n_ok"))
    chosen = runs.filter((F.col("n_rows") == expected) & (F.col("n_ok") > 0)).groupBy("noise", "model").agg(F.min("seed").alias("seed"))
    # a row per noise and model
    return scored.filter("ok is not null").join(F.broadcast(chosen), ["noise", "model", "seed"], "left_semi")


def noise_pivot(scores: DataFrame, models: Sequence[str], chosen: bool = False) -> DataFrame:
    """A4: one row per (noise, subject, qid, rep), one boolean column per model
    (the lowest seed's reply for each noise and model; ``chosen``: the scores are those already).

    The rows are hash-partitioned on (subject, qid): the pivot and every later per-question
    grouping (differences per question and pair, the noise pivot, covariances) group on a
    superset of that key, so they reuse this one shuffle. A question holds at most
    noises x models x repeats rows."""
    s = (scores if chosen else first_seed(scores)).repartition("subject", "qid")
    return s.groupBy("noise", "subject", "qid", "rep").agg(
        *[F.max(F.when(F.col("model") == m, F.col("ok"))).alias(m) for m in models])


def subjects(questions: DataFrame) -> DataFrame:
    """Distinct subjects."""
    return questions.select("subject").distinct()


def noise_stack(questions: DataFrame, n_repeats: int, noises: Sequence[str]) -> DataFrame:
    """T4: the subject of every (question, repeat), stacked once per noise."""
    return questions.select(F.explode(F.array(*[F.lit(n) for n in noises])).alias("noise"), "qid", "subject",
                            F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep"))


def noise_lists(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Wide list form: per (noise, subject, qid) one array of per-repeat results for each
    model (arrays are bounded by the repeat count)."""
    s = first_seed(scores)
    aggs = [F.transform(F.array_sort(F.collect_list(F.when(F.col("model") == m, F.struct("rep", "ok")))),
                        lambda x: x["ok"]).alias(m) for m in models]
    return s.groupBy("noise", "subject", "qid").agg(*aggs)


def parallel_explode(df: DataFrame, cols: Sequence[str], pos: str = "rep") -> DataFrame:
    """T5: explode several array columns in lock-step, with the element position."""
    keep = [c for c in df.columns if c not in cols]
    z = F.arrays_zip(*[F.col(c) for c in cols])
    return df.select(*keep, F.posexplode(z).alias(pos, "z")).select(*keep, pos, *[F.col("z")[c].alias(c) for c in cols])
