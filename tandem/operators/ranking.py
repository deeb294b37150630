"""Average win-rates, their covariance, rank-sets and the summary table.

The reference builds k x n one-hot matrices; here every quantity is a small
aggregate of the pair-count table (one row per noise, canonical pair):

* theta_m = (wins of m) / (comparisons m appears in)                       (A18)
* Sigma = A A^T / n^2, A the per-comparison residual of each side, n = all
  comparisons of the noise (not appearances)                                (A19)
* rank-set of m = [1 + #surely better, k - #surely worse]                   (A20)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.stats import chi2_ppf
from tandem.operators.pairwise import NOISES, Z95, model_grid, oriented


def side_rows(canon: DataFrame) -> DataFrame:
    """The one-hot design in long form: two rows per comparison (model, win 0/1)."""
    s = F.explode(F.array(
        F.struct(F.col("model_a").alias("model"), F.col("mrank_a").alias("mrank"),
                 (F.col("winner") == "A").cast("int").alias("win")),
        F.struct(F.col("model_b").alias("model"), F.col("mrank_b").alias("mrank"),
                 (F.col("winner") == "B").cast("int").alias("win")))).alias("s")
    return canon.select("noise", s).select("noise", "s.*")


def avg_winrate(counts: DataFrame) -> DataFrame:
    """Theta per (noise, model) = wins / appearances (a tie is a loss for both)."""
    o = oriented(counts)
    return o.groupBy("noise", "model", "mrank").agg(
        F.sum("n").cast("bigint").alias("appearances"),
        F.sum("wins").cast("bigint").alias("wins")) \
        .withColumn("theta", F.col("wins") / F.col("appearances"))


def winrate_cov(counts: DataFrame, theta: DataFrame, models: Sequence[str],
                noises: Sequence[str] = NOISES) -> DataFrame:
    """Sigma (noise, model_i, model_j, sigma) over the full model grid, zero-filled.

    Residuals per side: 1 - theta for a win, -theta otherwise; Sigma_ij sums products
    of the two sides' residuals over comparisons of i and j, divided by n^2.
    """
    th = F.broadcast(theta.select("noise", "model", "theta"))   # k x noises rows
    c = counts.join(th.withColumnRenamed("model", "model_a").withColumnRenamed("theta", "ta"), ["noise", "model_a"]) \
        .join(th.withColumnRenamed("model", "model_b").withColumnRenamed("theta", "tb"), ["noise", "model_b"])
    n, wa, wb, t = F.col("n"), F.col("wins_a"), F.col("wins_b"), F.col("ties")
    ta, tb = F.col("ta"), F.col("tb")
    diag_a = wa * (1 - ta) * (1 - ta) + (n - wa) * ta * ta
    diag_b = wb * (1 - tb) * (1 - tb) + (n - wb) * tb * tb
    off = wa * (1 - ta) * (-tb) + wb * (-ta) * (1 - tb) + t * ta * tb
    parts = c.select("noise", "n", F.explode(F.array(
        F.struct(F.col("model_a").alias("model_i"), F.col("model_a").alias("model_j"), diag_a.alias("v")),
        F.struct(F.col("model_b").alias("model_i"), F.col("model_b").alias("model_j"), diag_b.alias("v")),
        F.struct(F.col("model_a").alias("model_i"), F.col("model_b").alias("model_j"), off.alias("v")),
        F.struct(F.col("model_b").alias("model_i"), F.col("model_a").alias("model_j"), off.alias("v")))).alias("p")) \
        .select("noise", "n", "p.*")
    total = counts.groupBy("noise").agg(F.sum("n").alias("n_total"))
    s = parts.groupBy("noise", "model_i", "model_j").agg(F.sum("v").alias("sv")) \
        .join(F.broadcast(total), "noise") \
        .select("noise", "model_i", "model_j",
                (F.col("sv") / (F.col("n_total").cast("double") * F.col("n_total"))).alias("sigma"))
    grid = model_grid(counts.sparkSession, models, noises) \
        .select("noise", F.col("model").alias("model_i"), F.col("opponent").alias("model_j"))
    # Sigma has at most k^2 x noises rows (bounded by the model list): broadcast it
    return grid.join(F.broadcast(s), ["noise", "model_i", "model_j"], "left") \
        .select("noise", "model_i", "model_j", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def rank_sets(theta: DataFrame, sigma: DataFrame, k: int, alpha: float = 0.05) -> DataFrame:
    """Rank-set [lo, hi] per (noise, model) at level ``alpha`` with k models.

    For each other model: d = |theta_1 - theta_2| / sqrt(2)
    - sqrt((S11 + S22 - 2 S12) * chi2_{1-alpha}(k) / 2); if d > 0 the better model is
    surely better. lo = 1 + #surely better others, hi = k - #surely worse others.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must be between 0 and 1")
    q = chi2_ppf(1.0 - alpha, k)
    th = F.broadcast(theta.select("noise", "model", "theta"))          # k x noises rows
    diag = F.broadcast(sigma.filter(F.col("model_i") == F.col("model_j"))
                       .select("noise", F.col("model_i").alias("model"), F.col("sigma").alias("sii")))
    pairs = sigma.filter(F.col("model_i") != F.col("model_j")) \
        .join(th.select("noise", F.col("model").alias("model_i"), F.col("theta").alias("t1")), ["noise", "model_i"]) \
        .join(th.select("noise", F.col("model").alias("model_j"), F.col("theta").alias("t2")), ["noise", "model_j"]) \
        .join(diag.select("noise", F.col("model").alias("model_i"), F.col("sii").alias("s11")), ["noise", "model_i"]) \
        .join(diag.select("noise", F.col("model").alias("model_j"), F.col("sii").alias("s22")), ["noise", "model_j"])
    d = F.abs(F.col("t1") - F.col("t2")) / F.sqrt(F.lit(2.0)) - F.sqrt(
        (F.col("s11") + F.col("s22") - 2 * F.col("sigma")) * F.lit(q / 2.0))
    better = (d > 0) & (F.col("t1") < F.col("t2"))
    worse = (d > 0) & (F.col("t1") > F.col("t2"))
    r = pairs.groupBy("noise", F.col("model_i").alias("model")).agg(
        (1 + F.sum(better.cast("int"))).cast("int").alias("lo"),
        (F.lit(k) - F.sum(worse.cast("int"))).cast("int").alias("hi"))
    return th.join(F.broadcast(r), ["noise", "model"], "left").select(
        "noise", "model", F.coalesce("lo", F.lit(1)).alias("lo"), F.coalesce("hi", F.lit(k)).alias("hi"))


def rank_table(theta: DataFrame, sigma: DataFrame, ranks: DataFrame, models: Sequence[str],
               labels: Sequence[str] | None = None) -> DataFrame:
    """A21 + P8 + P17: per model its label, rank (min rank by rank-set lower bound),
    average win-rate and 95% interval 1.96 sqrt(Sigma_ii) rounded to 4 places, one
    column group per noise."""
    labels = list(labels or models)
    lab = F.array(*[F.lit(x) for x in labels])
    pos = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    diag = sigma.filter(F.col("model_i") == F.col("model_j")) \
        .select("noise", F.col("model_i").alias("model"), F.col("sigma"))
    w = Window.partitionBy("noise").orderBy("lo")      # k rows per noise
    # theta, diag and ranks have k x noises rows each (bounded by the model list)
    per = theta.select("noise", "model", "theta").join(F.broadcast(diag), ["noise", "model"]) \
        .join(F.broadcast(ranks), ["noise", "model"]) \
        .withColumn("rank", F.rank().over(w).cast("int")) \
        .withColumn("ci", F.round(F.lit(Z95) * F.sqrt("sigma"), 4))
    cp, ip = F.col("noise") == "Coupled", F.col("noise") == "Independent"
    out = per.groupBy("model").agg(
        F.max(F.when(cp, F.col("rank"))).alias("rank_coupled"),
        F.max(F.when(cp, F.col("theta"))).alias("winrate_coupled"),
        F.max(F.when(cp, F.col("ci"))).alias("ci_coupled"),
        F.max(F.when(ip, F.col("rank"))).alias("rank_independent"),
        F.max(F.when(ip, F.col("theta"))).alias("winrate_independent"),
        F.max(F.when(ip, F.col("ci"))).alias("ci_independent"))
    return out.withColumn("label", F.element_at(lab, pos.cast("int"))) \
        .select("model", "label", "rank_coupled", "winrate_coupled", "ci_coupled",
                "rank_independent", "winrate_independent", "ci_independent")
