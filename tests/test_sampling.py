"""Softmax, Gumbel-max draws, reply assembly."""

from pyspark.sql import functions as F

from tandem.operators import sampling as sa
from tandem.plans import q_sampling as qs
from conftest import SF01


def test_softmax_sums_to_one(spark):
    p = qs.probs(spark, SF01)
    tot = p.groupBy("unit", "step", "model").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in tot)


def test_coupled_draws_agree_more(spark):
    lg = qs.logits(spark, SF01)
    pr = sa.softmax(lg, qs.TEMPERATURE)

    def agreement(draws):
        d = draws.groupBy("unit").agg(F.countDistinct("joint_id").alias("k"), F.count(F.lit(1)).alias("m"))
        return d.filter("k = 1 and m > 1").count()

    c = agreement(sa.draw(pr, qs.coupled_seeds(lg)))
    i = agreement(sa.draw(pr, qs.independent_seeds(lg)))
    assert c > 2 * i


def test_draw_restricted_to_own_vocabulary(spark):
    lg = qs.logits(spark, SF01)
    d = sa.draw(sa.softmax(lg, qs.TEMPERATURE), qs.coupled_seeds(lg))
    assert d.join(lg, ["unit", "step", "model", "joint_id"], "left_anti").count() == 0


def test_reply_text_rules(spark):
    rows = [(1, 0, "signup"), (1, 1, "a"), (1, 2, "b"), (1, 3, "error"), (1, 4, "c"),
            (2, 0, "error"), (2, 1, "x"), (3, 0, "p"), (3, 1, "q"), (3, 2, "r")]
    t = spark.createDataFrame(rows, "unit long, step long, token string")
    got = {r.unit: (r.n_tokens, r.text) for r in sa.reply_text(t, "error", 2, ["signup"]).collect()}
    assert got == {1: (1, "a"), 2: (0, ""), 3: (2, "p q")}
    cut = sa.eos_cut(t, "error").collect()
    assert sorted((r.unit, r.step) for r in cut) == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1), (3, 2)]


def test_array_form_equals_long_form_without_a_shuffle(spark):
    lg = qs.logits(spark, SF01)
    long = sa.draw(sa.softmax(lg, qs.TEMPERATURE), qs.coupled_seeds(lg))
    arrays = qs.coupled_draw(spark, SF01)
    assert sorted(map(tuple, arrays.select(*long.columns).collect())) == sorted(map(tuple, long.collect()))
    d = spark.createDataFrame([(1, 0, 0, [(5, 0, 1.0), (9, 1, 1.0)], 7)],
                              "unit long, step int, model int, toks array<struct<joint_id:int,token_id:int,logit:double>>, seed long")
    out = sa.draw_arrays(sa.softmax_arrays(d, 1.0))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.collect()[0]
    assert (r.joint_id, r.token_id) in ((5, 0), (9, 1))


def test_softmax_arrays_compute_maximum_and_sum_once(spark):
    """Neither inside a lambda, once for each token, nor again in a filter that the planner infers from the explode."""
    import numpy as np
    plan = qs.q_softmax(spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("array_max(") == 1 and "size(" not in plan
    rows = [(1, 0, 0, [(j, j, x) for j, x in enumerate([0.5, -1.0, None, 2.0])]), (2, 0, 0, []), (3, 0, 0, None), (4, 0, 0, [(7, 0, -800.0)])]
    d = spark.createDataFrame(rows, "unit long, step int, model int, toks array<struct<joint_id:int,token_id:int,logit:double>>")
    got = {r.unit: r.toks for r in sa.softmax_arrays(d.where("unit <> 1"), 0.7).collect()}
    assert got[2] == [] and got[3] is None and [tuple(t) for t in got[4]] == [(7, 0, -800.0, 1.0)]
    x = np.linspace(-3, 3, 500)
    one = spark.createDataFrame([(1, 0, 0, [(j, j, float(v)) for j, v in enumerate(x)])], d.schema)
    p = [t.p for t in sa.softmax_arrays(one, 0.7).first().toks]
    assert np.allclose(p, np.exp(x / 0.7) / np.exp(x / 0.7).sum(), rtol=1e-12)
    assert [t.p for t in sa.softmax_arrays(d.where("unit = 1"), 0.7).first().toks] == [None] * 4
