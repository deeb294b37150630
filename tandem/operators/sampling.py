"""Token sampling with shared (coupled) or per-model (independent) Gumbel noise.

The reference draws ``n_total`` uniforms per step from a generator re-seeded per
prompt, so a token's noise depends only on (prompt seed, step, joint id). Here the
noise is a keyed-uniform column of those keys: models that share the prompt seed
share the noise (coupled), models with their own seeds do not (independent).

A distribution is one row: (unit, step, model, toks), ``toks`` an array of (joint_id, token_id,
logit) over the model's own vocabulary, token_id being the model's own id. Softmax and draw are then
row-local, without a shuffle. Long tables (unit, step, model, joint_id, logit) have :func:`softmax` and
:func:`draw`, which shuffle every logit once to bring a distribution together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.hashing import gumbel, uniform

EPS = 1e-20   # fixed value: guard inside the logarithms


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: a column that a lambda captures is inlined by the planner and computed again
    for each element."""
    return F.transform(F.array(value), body)[0]


def softmax_arrays(dists: DataFrame, temperature: float) -> DataFrame:
    """P11 + W4 on array rows: ``toks`` with the probability ``p`` added to each element. No shuffle. The maximum and the sum
    of a distribution are computed once, so the work is in proportion to its length."""
    z = F.transform("toks", lambda t: t["logit"] / F.lit(float(temperature)))
    e = _bound(z, lambda y: _bound(F.array_max(y), lambda m: F.transform(y, lambda x: F.exp(x - m))))

    def shares(toks, es, total):
        return F.zip_with(toks, es, lambda t, x: F.struct(t["joint_id"].alias("joint_id"), t["token_id"].alias("token_id"),
                                                          t["logit"].alias("logit"), (x / total).alias("p")))

    p = _bound(e, lambda es: _bound(F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda total: shares(F.col("toks"), es, total)))
    return dists.withColumn("toks", p)


def draw_arrays(probs: DataFrame) -> DataFrame:
    """A22 + J8 + J6 on array rows with a ``seed`` column: the token maximising ln(p + 1e-20) +
    g(seed, step, joint id), ties to the lower joint id, as (joint_id, token_id). The seed is a
    function of the unit (coupled) or of unit and model (independent). No shuffle."""
    def scored(t):
        g = gumbel(uniform(F.col("seed"), F.col("step"), t["joint_id"]))
        return F.struct((F.log(t["p"] + F.lit(EPS)) + g).alias("score"), (-t["joint_id"]).alias("neg"), t["token_id"].alias("token_id"))

    best = F.array_max(F.transform("toks", scored))
    return probs.withColumn("_b", best).select("unit", "step", "model", (-F.col("_b.neg")).cast("int").alias("joint_id"),
                                               F.col("_b.token_id").cast("int").alias("token_id"))


def softmax(logits: DataFrame, temperature: float, keys: Sequence[str] = ("unit", "step", "model")) -> DataFrame:
    """P11 + W4: temperature softmax over each (unit, step, model) distribution.

    A window partition is one distribution, bounded by the model's vocabulary size."""
    w = Window.partitionBy(*keys)
    z = F.col("logit") / F.lit(float(temperature))
    e = logits.withColumn("_z", z).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def noise(units: DataFrame, seed_col: str = "seed") -> DataFrame:
    """P12 + R6: uniform and Gumbel noise of every (seed, step, joint id) row."""
    u = uniform(seed_col, "step", "joint_id")
    return units.withColumn("u", u).withColumn("g", gumbel(F.col("u")))


def draw(probs: DataFrame, seeds: DataFrame, keys: Sequence[str] = ("unit", "step", "model")) -> DataFrame:
    """A22 + J8: Gumbel-max draw per (unit, step, model): the token maximising
    ln(p + 1e-20) + g(seed, step, joint id), ties to the lower joint id.

    ``seeds`` holds the seed per unit (coupled) or per (unit, model) (independent); the
    argmax only ranges over the rows present, i.e. the model's own vocabulary. After
    :func:`softmax` the rows of a distribution are together already."""
    on = [c for c in seeds.columns if c != "seed"]
    s = probs.join(seeds, on)
    score = F.log(F.col("p") + F.lit(EPS)) + gumbel(uniform("seed", "step", "joint_id"))
    best = s.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("joint_id")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).cast("int").alias("joint_id"))


def eos_step(tokens: DataFrame, eos: str) -> DataFrame:
    """First end-of-sequence step per unit (NULL when the unit has none)."""
    return tokens.groupBy("unit").agg(F.min(F.when(F.col("token") == eos, F.col("step"))).alias("eos_step"))


def eos_cut(tokens: DataFrame, eos: str) -> DataFrame:
    """Keep the tokens before the first end token of each unit."""
    e = eos_step(tokens, eos)
    return tokens.join(e, "unit").filter(F.col("eos_step").isNull() | (F.col("step") < F.col("eos_step"))) \
        .drop("eos_step")


def reply_text(tokens: DataFrame, eos: str, max_length: int, special: Sequence[str] = (),
               sep: str = " ") -> DataFrame:
    """The reply of each unit: tokens in step order, generation stops after
    ``max_length`` steps or at the first end token, special tokens (and the end token)
    are dropped, pieces joined by ``sep``. One aggregation; each unit's list is bounded
    by ``max_length``."""
    t = tokens.filter(F.col("step") < F.lit(max_length))
    g = t.groupBy("unit").agg(
        F.min(F.when(F.col("token") == eos, F.col("step"))).alias("eos_step"),
        F.collect_list(F.struct("step", "token")).alias("toks"))
    drop = [eos, *special]
    kept = F.filter(F.array_sort("toks"), lambda x: (x["step"] < F.coalesce(F.col("eos_step"), F.lit(max_length)))
                    & ~x["token"].isin(drop))
    return g.select("unit", F.size(kept).cast("int").alias("n_tokens"),
                    F.array_join(F.transform(kept, lambda x: x["token"]), sep).alias("text"))
