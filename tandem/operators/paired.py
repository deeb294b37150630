"""Paired analysis of scores: per-question variance / covariance of model differences.

Pairs come from the ordered model list (i < j, or cyclic), never from a self-join:
the noise x model pivot puts every model's result of one (noise, question, repeat)
on one row, and each pair is a column expression on it. One shuffle (the pivot).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.indexing import _null_safe_join, ordinal
from tandem.session import write_once

def exact_variance(c: Column) -> Column:
    """Sample variance (ddof 1) of integers from their integer sums: equal rows give equal bits, in whatever order they are met."""
    n, d = F.count(c), c.cast("long")
    return (n * F.sum(d * d) - F.sum(d) * F.sum(d)) / F.nullif(n * (n - 1), F.lit(0).cast("long"))


# Metric by name -> aggregate over the per-repeat differences of one question.
METRICS = {
    "var": exact_variance,
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.sqrt(exact_variance(c)),
    "sum": lambda c: F.sum(c).cast("double"),
    "count": lambda c: F.count(c).cast("double"),
}


def ordered_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """All (model_i, model_j) with i < j in list order."""
    return [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]


def cyclic_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """(m0, m1), (m1, m2), ..., (m_{k-1}, m0)."""
    k = len(models)
    return [(models[i], models[(i + 1) % k]) for i in range(k)]


def _pair_rows(pivot: DataFrame, pairs, keys: Sequence[str], value) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), *value(a, b))
                    for a, b in pairs])
    return pivot.select(*keys, F.explode(arr).alias("p")).select(*keys, "p.*")


def pair_diffs(pivot: DataFrame, models: Sequence[str], subject: str | None = None) -> DataFrame:
    """J5 + P18 (+ P9): score difference ok_a - ok_b in {-1, 0, 1} for every ordered pair,
    one row per (noise, subject, qid, rep, model_a, model_b)."""
    if subject is not None:
        pivot = pivot.filter(F.col("subject") == subject)
    keys = ["noise", "subject", "qid", "rep"]
    return _pair_rows(pivot, ordered_pairs(models), keys,
                      lambda a, b: [(F.col(a).cast("int") - F.col(b).cast("int")).alias("diff")])


def paired_rows(pivot: DataFrame, pairs, noise: str | None = "Coupled") -> DataFrame:
    """J9 input: (subject, qid, rep, model_a, model_b, ok_a, ok_b) for the given pairs."""
    if noise is not None:
        pivot = pivot.filter(F.col("noise") == noise)
    keys = ["noise", "subject", "qid", "rep"]
    return _pair_rows(pivot, pairs, keys, lambda a, b: [F.col(a).cast("int").alias("ok_a"),
                                                         F.col(b).cast("int").alias("ok_b")])


def metric_per_question(diffs: DataFrame, metric: str = "var") -> DataFrame:
    """A5 / A6 (U3): aggregate of the differences per (noise, subject, qid, pair) over repeats
    (ddof = 1 for var/std; a single repeat gives NULL)."""
    fn = METRICS[metric]
    return diffs.groupBy("noise", "subject", "qid", "model_a", "model_b").agg(fn(F.col("diff")).alias(metric))


def pivot_noise(per_question: DataFrame, value: str, noises: Sequence[str] = ("Coupled", "Independent")) -> DataFrame:
    """One row per (subject, qid, pair), one column per noise (lower-case name)."""
    return per_question.groupBy("subject", "qid", "model_a", "model_b").agg(
        *[F.max(F.when(F.col("noise") == n, F.col(value))).alias(n.lower()) for n in noises])


def question_cov(paired: DataFrame) -> DataFrame:
    """Sample covariance (ddof = 1) of the two models' correctness per question."""
    return paired.groupBy("subject", "qid", "model_a", "model_b").agg(
        F.covar_samp(F.col("ok_a").cast("double"), F.col("ok_b").cast("double")).alias("cov"))


_BINS = 65535


def _octave_bin(v) -> Column:
    """A number that never falls as ``v`` grows: sign and 1/64 octaves of the size; NaN is the largest."""
    size = F.floor(F.log2(F.abs(v)) * 64) + 80_000
    at = F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), 1 << 20).otherwise(size)
    return F.when(F.isnan(v), 1 << 21).when(v < 0, -at).otherwise(at).cast("long")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", max_rounds: int = 64) -> DataFrame:
    """Exact median of ``value`` (as double) per ``keys``: the mean of the two middle values for even n; NULL values are
    ignored, NaN is larger than any number, a null key is a group of its own.

    Selection by refined histograms: a round counts the rows of each bin (map-side combined, with the
    bin's least and largest value), and running counts tell the bin of each middle rank. A bin of one
    value is the answer; any other is cut into 65,536 equal parts in the next round. Each round reads ``df`` again and
    sends bins only; its rows are neither sorted nor written, so ``df`` must give equal values each time it is read (write
    it first where it does not, as with sums of doubles in no fixed order). Bins of the first round are 1/64 octave wide, so few rounds
    are left, however far apart the values of a group are."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bins, open_ = rows.withColumn("_bin", _octave_bin(F.col("_v"))), None
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        cell = keys if open_ is None else [*keys, "_lo", "_hi"]
        hist = write_once(bins.groupBy(*cell, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
        total = F.sum("_n").over(Window.partitionBy(*cell))
        upto = F.sum("_n").over(Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumns({"_upto": upto, "_total": total})
        if open_ is None:
            # ranks (from 0) of the lower and upper middle value
            ranked = hist.withColumn("_rank", F.explode(F.array(F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2))))
        else:
            ranked = _null_safe_join(hist, open_, [*keys, "_lo", "_hi"])
        before = F.col("_upto") - F.col("_n")
        hit = write_once(ranked.filter((before <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
                         .select(*keys, "_least", "_most", (F.col("_rank") - before).alias("_rank")))
        found.append(hit.filter("_least = _most").select(*keys, F.col("_least").alias("_v")))
        left = hit.filter("_least <> _most").select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_rank")
        if left.isEmpty():
            break
        open_ = left
        inside = _null_safe_join(rows, left.select(*keys, "_lo", "_hi").distinct(), keys) \
            .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _BINS)
        bins = inside.withColumn("_bin", part.cast("long"))
    both = reduce(DataFrame.unionByName, found)
    low, high = F.min("_v"), F.max("_v")
    return both.groupBy(*keys).agg(F.when(low == high, low).otherwise((low + high) / 2).alias(name))


def question_numbers(questions: DataFrame) -> DataFrame:
    """0-based question number inside its subject (by qid; repeated rows count once)."""
    return ordinal(questions.select("subject", "qid").distinct(), ["subject"], ["qid"], "question_no")
