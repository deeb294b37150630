"""Pairwise judgements: canonical order, win-rates, ties, two-proportion z-tests.

Raw comparisons are read once: one partially aggregated shuffle on
(noise, model_a, model_b) reduces n comparisons to at most 3 * k(k-1)/2 count rows
per noise, and every statistic below (win-rates, ties, z-tests, average win-rates,
covariance, rank-sets) is computed from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.stats import significance_code

# ---- fixed values -----------------------------------------------------------------
NOISES = ["Coupled", "Independent"]   # the two generation modes compared
Z95 = 1.96                             # normal quantile used for win-rate intervals


def model_rank(col: Column | str, models: Sequence[str]) -> Column:
    """0-based position of a model in the ordered model list; NULL when unknown."""
    col = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(m) for m in models]), col)
    return F.when(pos > 0, (pos - 1).cast("int"))


def _with_ranks(comparisons: DataFrame, models: Sequence[str]) -> DataFrame:
    return comparisons.withColumn("mrank_a", model_rank("model_a", models)) \
        .withColumn("mrank_b", model_rank("model_b", models))


def canonical_pairs(comparisons: DataFrame, models: Sequence[str]) -> DataFrame:
    """Orient every comparison so that rank(model_a) <= rank(model_b).

    A swapped row exchanges models and seeds and turns A<->B (Tie kept). Rows naming a
    model outside ``models`` are rejected (see :func:`unknown_model_rows`). Adds
    ``mrank_a``, ``mrank_b``. Idempotent.
    """
    r = _with_ranks(comparisons, models).filter(F.col("mrank_a").isNotNull() & F.col("mrank_b").isNotNull())
    swap = F.col("mrank_a") > F.col("mrank_b")
    flip = {"model_a": "model_b", "model_b": "model_a", "seed_a": "seed_b", "seed_b": "seed_a",
            "mrank_a": "mrank_b", "mrank_b": "mrank_a"}
    cols = []
    for c in r.columns:
        if c in flip and flip[c] in r.columns:
            cols.append(F.when(swap, F.col(flip[c])).otherwise(F.col(c)).alias(c))
        elif c == "winner":
            w = F.col("winner")
            cols.append(F.when(swap & (w == "A"), "B").when(swap & (w == "B"), "A").otherwise(w).alias(c))
        else:
            cols.append(F.col(c))
    return r.select(*cols)


def unknown_model_rows(comparisons: DataFrame, models: Sequence[str]) -> DataFrame:
    """Comparisons naming a model outside the list (the reference raises on them)."""
    r = _with_ranks(comparisons, models)
    return r.filter(F.col("mrank_a").isNull() | F.col("mrank_b").isNull()).drop("mrank_a", "mrank_b")


def reject_counts(comparisons: DataFrame, models: Sequence[str], keys: Sequence[str] = ("noise",)) -> DataFrame:
    """Rejected comparisons per (keys, model_a, model_b) as written, with the (first) unknown model: the report that
    goes with :func:`canonical_pairs`, whose accepted rows and these add up to the input. A null model is unknown."""
    unknown = F.when(model_rank("model_a", models).isNull(), F.col("model_a")).otherwise(F.col("model_b"))
    return unknown_model_rows(comparisons, models).groupBy(*keys, "model_a", "model_b", unknown.alias("unknown")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def pair_counts(canon: DataFrame, keys: Sequence[str] = ("noise",)) -> DataFrame:
    """Outcome counts per (keys, model_a, model_b): n, wins_a, wins_b, ties.

    Partial (map-side) aggregation makes the shuffle a few rows per task, so a pair
    holding a third of all comparisons costs no more than any other.
    """
    w = F.col("winner")
    return canon.groupBy(*keys, "model_a", "model_b", "mrank_a", "mrank_b").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum((w == "A").cast("int")).cast("bigint").alias("wins_a"),
        F.sum((w == "B").cast("int")).cast("bigint").alias("wins_b"),
        F.sum((w == "Tie").cast("int")).cast("bigint").alias("ties"),
    )


def oriented(counts: DataFrame, keys: Sequence[str] = ("noise",)) -> DataFrame:
    """Each count row from both sides: (keys, model, opponent, mrank, orank, n, wins, losses, ties)."""
    side = F.explode(F.array(
        F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("opponent"),
                 F.col("mrank_a").alias("mrank"), F.col("mrank_b").alias("orank"),
                 F.col("wins_a").alias("wins"), F.col("wins_b").alias("losses")),
        F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("opponent"),
                 F.col("mrank_b").alias("mrank"), F.col("mrank_a").alias("orank"),
                 F.col("wins_b").alias("wins"), F.col("wins_a").alias("losses")))).alias("s")
    return counts.select(*keys, "n", "ties", side).select(*keys, "s.*", "n", "ties")


def pair_winrates(counts: DataFrame, keys: Sequence[str] = ("noise",)) -> DataFrame:
    """A13 + A14: win-rate of model over opponent (ties count in the denominator) and its
    normal 95% half-width, both directions of every played canonical pair."""
    o = oriented(counts, keys)
    p = F.col("wins") / F.col("n")
    return o.select(*keys, "model", "opponent", "n", "wins", p.alias("winrate"),
                    (F.lit(Z95) * F.sqrt(p * (1 - p) / F.col("n"))).alias("ci"))


def model_grid(spark, models: Sequence[str], noises: Sequence[str] | None = None) -> DataFrame:
    """All (noise,) model, opponent combinations of the model list, by array explosion."""
    arr = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("r")) for i, m in enumerate(models)])
    g = spark.range(1).select(F.explode(arr).alias("x")).select(
        F.col("x.m").alias("model"), F.col("x.r").alias("mrank"), F.explode(arr).alias("y")) \
        .select("model", "mrank", F.col("y.m").alias("opponent"), F.col("y.r").alias("orank"))
    if noises is not None:
        g = g.select(F.explode(F.array(*[F.lit(n) for n in noises])).alias("noise"), "*")
    return g


def pair_ties(counts: DataFrame, models: Sequence[str], noises: Sequence[str] = NOISES) -> DataFrame:
    """Symmetric tie matrix per noise over the whole model grid, zero-filled.

    The diagonal holds ties of a model against itself (zero unless such rows exist)."""
    t = counts.select("noise", F.explode(F.array_distinct(F.array(
        F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("opponent")),
        F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("opponent"))))).alias("p"), "ties") \
        .select("noise", "p.*", "ties").groupBy("noise", "model", "opponent").agg(F.sum("ties").alias("ties"))
    grid = model_grid(counts.sparkSession, models, noises)
    # the tie table has at most k^2 x noises rows (bounded by the model list): broadcast it
    return grid.join(F.broadcast(t), ["noise", "model", "opponent"], "left") \
        .select("noise", "model", "opponent", F.coalesce("ties", F.lit(0)).cast("bigint").alias("ties"))


def tie_increase(ties: DataFrame) -> DataFrame:
    """A16 + J10: relative increase of ties under coupled vs independent noise, in percent;
    0 on the diagonal, NULL when the independent count is 0."""
    agg = ties.groupBy("model", "opponent").agg(
        F.sum(F.when(F.col("noise") == "Coupled", F.col("ties"))).cast("bigint").alias("ties_coupled"),
        F.sum(F.when(F.col("noise") == "Independent", F.col("ties"))).cast("bigint").alias("ties_independent"))
    inc = F.when(F.col("model") == F.col("opponent"), F.lit(0.0)).otherwise(
        100.0 * (F.col("ties_coupled") - F.col("ties_independent"))
        / F.nullif(F.col("ties_independent"), F.lit(0)).cast("double"))
    return agg.withColumn("increase", inc)


def pair_ztest(counts: DataFrame) -> DataFrame:
    """A17 + J10 + P15: pooled two-proportion z-test of the win-rate of ``model`` over
    ``opponent`` under coupled vs independent noise, for every ordered pair that played.

    Wins of the model are counted in both orientations (as A and as B)."""
    o = oriented(counts)
    cp = F.col("noise") == "Coupled"
    ip = F.col("noise") == "Independent"
    g = o.groupBy("model", "opponent").agg(
        F.coalesce(F.sum(F.when(cp, F.col("n"))), F.lit(0)).cast("bigint").alias("n_s"),
        F.coalesce(F.sum(F.when(cp, F.col("wins"))), F.lit(0)).cast("bigint").alias("wins_s"),
        F.coalesce(F.sum(F.when(ip, F.col("n"))), F.lit(0)).cast("bigint").alias("n_d"),
        F.coalesce(F.sum(F.when(ip, F.col("wins"))), F.lit(0)).cast("bigint").alias("wins_d"))
    ns, nd = F.nullif(F.col("n_s"), F.lit(0)), F.nullif(F.col("n_d"), F.lit(0))
    p_s = F.col("wins_s") / ns
    p_d = F.col("wins_d") / nd
    p = (F.col("wins_s") + F.col("wins_d")) / (F.col("n_s") + F.col("n_d"))
    den = F.sqrt(p * (1 - p) * (1.0 / ns + 1.0 / nd))
    z = (p_s - p_d) / F.nullif(den, F.lit(0.0))
    return g.withColumn("z", z).withColumn("code", significance_code(F.col("z")))
