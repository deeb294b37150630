"""Properties from the survey's test strategy."""

import math

from pyspark.sql import functions as F

from tandem.operators import paired as pa
from tandem.operators import pairwise as pw
from tandem.operators import scoring as sc
from tandem.operators import vocab as vo
from tandem.plans import q_scores as qs
from tandem.sources import fixtures as fx
from conftest import SF001


def test_var_of_difference_identity(spark):
    piv = sc.noise_pivot(qs.scores(spark, SF001), fx.MC_MODEL_NAMES).filter(F.col("noise") == "Coupled")
    a, b = fx.MC_MODEL_NAMES[0], fx.MC_MODEL_NAMES[1]
    g = piv.groupBy("qid").agg(
        F.var_samp(F.col(a).cast("int") - F.col(b).cast("int")).alias("vd"),
        F.var_samp(F.col(a).cast("int")).alias("va"), F.var_samp(F.col(b).cast("int")).alias("vb"),
        F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias("c"))
    for r in g.collect():
        assert math.isclose(r.vd, r.va + r.vb - 2 * r.c, abs_tol=1e-12)
    d = pa.metric_per_question(pa.pair_diffs(piv, fx.MC_MODEL_NAMES), "var") \
        .filter((F.col("model_a") == a) & (F.col("model_b") == b))
    got = {r.qid: r.var for r in d.collect()}
    assert all(math.isclose(got[r.qid], r.vd, abs_tol=1e-12) for r in g.collect())


def test_counts_invariant_to_partitioning(spark):
    c = fx.comparisons(spark, SF001)
    one = sorted(map(tuple, pw.pair_counts(pw.canonical_pairs(c, fx.CMP_MODELS)).collect()))
    many = sorted(map(tuple, pw.pair_counts(pw.canonical_pairs(c.repartition(13), fx.CMP_MODELS)).collect()))
    assert one == many


def test_joint_ids_dense_and_bijective(spark):
    v = fx.vocabularies(spark, SF001)
    j = vo.joint_vocab(v)
    s = j.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("t"), F.countDistinct("joint_id").alias("i"),
              F.min("joint_id").alias("lo"), F.max("joint_id").alias("hi")).collect()[0]
    assert s.n == s.t == s.i == s.hi + 1 and s.lo == 0
    # first-appearance order: every id of the first model comes before any token new in later models
    first = j.join(v.filter(F.col("mrank") == 0), "token").agg(F.max("joint_id")).collect()[0][0]
    assert first == v.filter(F.col("mrank") == 0).count() - 1


def test_exact_median_even_and_odd(spark):
    rows = [("a", i, float(x)) for i, x in enumerate([5, 1, 3])] + [("b", i, float(x)) for i, x in enumerate([4, 1, 3, 2])]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r.g: r.median for r in pa.exact_median(df, ["g"], "v").collect()}
    assert got == {"a": 3.0, "b": 2.5}


def test_median_by_refined_histograms(spark):
    """Hot, null, tiny and wide-ranging groups, infinities and NaN, without a sort of the rows."""
    import numpy as np
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=3001), None: rng.exponential(size=200), "one": [3.5], "two": [1.0, -4.0],
              "zeros": [0.0, -0.0, 0.0, 5e-324], "wide": [-1e300, -1e-300, 1e-300, 1e300, 2.0, 3.0], "close": 1 + np.arange(501) * 2.0 ** -52,
              "mixed": np.concatenate([rng.normal(size=100) * 1e-9, rng.normal(size=101) * 1e9, np.full(300, 7.25)]),
              "inf": [float("inf"), float("-inf"), 1.0, 2.0, 3.0, float("inf")], "same": [2.5] * 1000}
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("hot", -1, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(6)
    got = {r.g: r.median for r in pa.exact_median(df, ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(float(x) for x in xs)
        a, b = xs[(len(xs) - 1) // 2], xs[len(xs) // 2]
        assert got[g] == (a if a == b else (a + b) / 2), g
    nan = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 5.0), (2, float("nan"))], "g int, v double")
    got = {r.g: r.median for r in pa.exact_median(nan, ["g"], "v").collect()}
    assert got[1] == 5.0 and got[2] != got[2]
    assert pa.exact_median(df.limit(0), ["g"], "v").count() == 0
    whole = pa.exact_median(df.where("g = 'hot'"), [], "v").collect()
    assert [r.median for r in whole] == [sorted(groups["hot"])[1500]]


def test_p_value_column_against_erfc(spark):
    import math

    from tandem.functions.stats import p_value
    zs = [0.0, 1e-12, -0.3, 1.0, -1.959964, 2.82, 2.8284271247461903, 2.83, 3.9, -6.5, 12.0, 25.0, 37.0, None, float("nan")]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", p_value(F.col("z")).alias("p"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        if r.z is None or r.z != r.z:
            assert r.p is None
        else:
            exact = math.erfc(abs(r.z) / math.sqrt(2))
            assert abs(r.p - exact) <= 1e-12 * exact + 1e-15, r.z


def test_vocabularies_of_a_hundred_models(spark):
    import random

    from tandem.operators.vocab import vocab_common
    rnd = random.Random(5)
    sets = [{f"t{x}" for x in rnd.sample(range(60), rnd.randint(0, 50))} for _ in range(100)]
    names = [f"model{i:03d}" for i in range(100)]
    rows = [(names[m], m, t, i) for m, s in enumerate(sets) for i, t in enumerate(sorted(s))]
    df = spark.createDataFrame(rows + rows[:50], "model string, mrank int, token string, token_id int").repartition(5)
    got = {(r.model1, r.model2): r.common for r in vocab_common(df, names).collect()}
    assert got == {(names[i], names[j]): len(sets[i] & sets[j]) for i in range(100) for j in range(i + 1, 100)}
    assert {r.common for r in vocab_common(df.limit(0), names[:3]).collect()} == {0}
    assert vocab_common(df, names[:1]).count() == 0


def test_first_row_is_one_aggregate(spark):
    from tandem.operators.runs import first_row
    df = spark.createDataFrame([(2, 1, "b"), (1, 5, "z"), (1, 3, "y"), (1, 3, "x")], "a int, b int, t string").repartition(3)
    got = first_row(df, ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(1, 3, "x", 0)] and got.columns == ["a", "b", "t", "pos"]
    assert "Sort " not in got._jdf.queryExecution().optimizedPlan().toString() and first_row(df.limit(0), ["a"]).count() == 0


def test_formatters_by_data_set(spark):
    import pytest

    from tandem.operators import prompts as pr
    q = spark.createDataFrame([(3, "Why?")], "pos long, question string")
    assert [tuple(r) for r in pr.prompts("lmsys", q, system="Short.").collect()] == [(3, "Why?", "Short.")]
    with pytest.raises(ValueError, match="lmsys, mmlu"):
        pr.prompts("other", q)
    with pytest.raises(ValueError, match="registered"):
        pr.formatter("mmlu")(pr.format_prompts)
