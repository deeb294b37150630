"""The error study's shuffles: copies of the rows and packed errors, not (row, iteration) pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import subsample as ss


def rows_of(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(g, q, int(rng.integers(-1, 2)), int(rng.integers(-300, 300))) for g, size in sizes for q in range(size)]
    return spark.createDataFrame(rows, "g string, q long, v1 int, v2 int")


def test_a_row_is_dealt_once_per_block(spark):
    """1000 iterations of a group of 200,000 rows: its rows go to four blocks, packed."""
    assert -(-ss.ITERATIONS // ss.BLOCKS) * 200_000 <= ss.CELL_PAIRS and 200_000 <= ss.BUCKET_ROWS
    import pyarrow as pa
    r, v = np.arange(5000, dtype=np.int32), np.ones(5000, np.int64)
    chunk = pa.RecordBatch.from_pydict({"gid": [0], "seq": [0], "size": [5000], "r": [r.tobytes()], "v": [ss._narrow(v)],
                                        "n_buckets": [1], "block_its": [-(-ss.ITERATIONS // ss.BLOCKS)]})
    out = list(ss._deal(["v"], ss.ITERATIONS, True)([chunk]))
    assert sum(sum(b.column("size").to_pylist()) for b in out) == ss.BLOCKS * 5000
    assert sum(b.nbytes for b in out) < ss.BLOCKS * 5000 * 6


@pytest.mark.parametrize("part", [3, 2048])
@pytest.mark.parametrize("bucket_rows", [10_000, 40])
def test_packed_errors_give_the_same_curve(spark, monkeypatch, part, bucket_rows):
    monkeypatch.setattr(ss, "PART", part)
    df = rows_of(spark, (("a", 90), (None, 250), ("tiny", 5)))
    args = (df, ["v1", "v2"], ["g"], ["q"])
    kw = {"iterations": 30, "step": 10, "seed": 2, "bucket_rows": bucket_rows}
    names = {"v1": ("m1", "m2"), "v2": ("m1", "m3")}
    keys = ["g", "model_a", "model_b"]

    def curve(e):
        got = ss.error_curve(ss.to_long(e, ["g", "iter", "n"], names), keys, draws=60, seed=1, iterations=30, step=10).collect()
        return {(r.g, r.model_b, r.n): (r.iterations, r.mean_err, r.ci_lo, r.ci_hi) for r in got}

    plain, packed = curve(ss.subsample_error(*args, **kw)), curve(ss.subsample_error(*args, packed=True, **kw))
    assert set(plain) == set(packed) and len(plain) == 2 * (8 + 24)
    assert all(np.allclose(plain[k], packed[k], rtol=1e-12) for k in plain)


def test_groups_beyond_what_a_cell_holds(spark, monkeypatch):
    """Smaller blocks for groups of more rows than a cell holds; the errors are the same."""
    df = rows_of(spark, (("a", 300), ("b", 40)))
    args = (df, ["v1"], ["g"], ["q"])
    want = {tuple(r) for r in ss.subsample_error(*args, iterations=12, seed=1, reduce=True).collect()}
    monkeypatch.setattr(ss, "HELD_ROWS", 100)
    got = {tuple(r) for r in ss.subsample_error(*args, iterations=12, seed=1, bucket_rows=30, reduce=True).collect()}
    assert got == want and len(want) == 14 + 1


def test_narrow_integers_round_trip():
    for x in ([-1, 0, 1], [-128, 127], [128], [-129], [2 ** 31], [-2 ** 63, 2 ** 63 - 1], []):
        x = np.array(x, np.int64)
        assert (ss._widened(ss._narrow(x), len(x)) == x).all()
    assert len(ss._narrow(np.array([-128, 127]))) == 2


def test_mixing_without_divisions_is_the_same_and_has_an_inverse():
    from tandem.functions.hashing import MIX_P, mix_np, mix_premixed_np, premixed_np, unmix_np
    r = np.concatenate([[0, 1, MIX_P - 1, MIX_P - 2], np.random.default_rng(1).integers(0, MIX_P, 5000)])
    for draw in (0, 1, 7, 999, 10 ** 6):
        want = mix_np(r, np.array([draw]))
        got = mix_premixed_np(premixed_np(r), draw, np.empty(len(r), np.uint32), 999)
        assert (got == want).all() and (unmix_np(want, draw) == r).all()


def cell(tuples, size, repeats, seed=5):
    """Seeds of a cell, some of them repeated, and its values: ``tuples`` different pairs."""
    rng = np.random.default_rng(seed)
    r = rng.integers(0, ss.MIX_P, size).astype(np.int32)
    r[rng.integers(0, size, repeats)] = r[rng.integers(0, size, repeats)]
    pairs = rng.integers(-6, 7, (tuples, 2)).astype(np.int8)
    return r, list(pairs[rng.integers(0, tuples, size)].T.copy())


@pytest.mark.parametrize("step", [20, 6])
@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("tuples,size,repeats", [(1, 700, 300), (2, 3000, 900), (7, 50_000, 9000), (30, 20_000, 100), (5, 400_000, 0)])
def test_keys_that_bring_values_along_give_the_same_sums(tuples, size, repeats, k, step):
    r, vals = cell(tuples, size, repeats)
    coded = ss._Coded.of(r, vals, step, k, size)
    for draw in (0, 11):
        for bucket in range(k):
            for before in ((0,) if k == 1 else (0, 3, step, 5 * step - 1)):
                got = ss._Ranked(r, np.array([draw]), bucket, k, np.array([before]), step, size)
                n, sums = coded.prefixes(draw, bucket, before)
                assert (n == got.n).all()
                assert all((s == got.prefix(v, np.zeros(1, np.int64))).all() for s, v in zip(sums, vals))


def test_ties_that_cannot_be_resolved_are_left_to_wide_keys():
    r, vals = cell(7, 50_000, 20_000)
    coded = ss._Coded.of(r, vals, 20, 1, len(r))
    coded.r = coded.r[::-1].copy()              # no seed is found
    assert coded.prefixes(0, 0, 0) is None
    wide = [np.arange(300), np.arange(300)]
    assert ss._Coded.of(np.arange(300, dtype=np.int32), wide, 20, 1, 300) is None


@pytest.mark.parametrize("form", [{"reduce": True}, {"packed": True}, {}])
@pytest.mark.parametrize("bucket_rows", [10_000, 150])
def test_coded_and_wide_cells_give_the_same_study(spark, monkeypatch, form, bucket_rows):
    rng = np.random.default_rng(3)
    rows = [(g, q, int(rng.integers(-1, 2)), int(rng.integers(-1, 2))) for g, size in (("a", 390), (None, 650), ("tiny", 5)) for q in range(size)]
    df = spark.createDataFrame(rows, "g string, q long, v1 int, v2 int")

    def study():
        e = ss.subsample_error(df, ["v1", "v2"], ["g"], ["q"], iterations=11, seed=4, bucket_rows=bucket_rows, **form)
        return sorted(map(repr, (tuple(r) for r in e.collect())))

    want = study()
    monkeypatch.setattr(ss, "CODED_ROWS", 1)
    assert study() == want and len(want) > 0


def test_rounding_without_decimals_equals_round(spark):
    from tandem.plans.registry import rounded
    rng = np.random.default_rng(2)
    x = [0.0, -0.0, 0.5, 2.5e-6, -2.5e-6, 1.0000005, 0.1234565, 0.1234575, 1e-300, -1e-9, 1e9, 123456789.1234565, 1e15 + 0.5, 1e300,
         float("inf"), float("-inf"), None, *map(float, rng.random(3000)), *(float(i) / 2e6 for i in range(-3000, 3000)),
         *map(float, rng.normal(size=2000) * 10.0 ** rng.integers(-9, 12, 2000))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    for places in (6, 9, 12, 0):
        both = rounded(df, places).join(df.select("i", (F.round("x", places) + F.lit(0.0)).alias("want")), "i")
        assert both.where("not (x <=> want)").count() == 0
    assert np.isnan(rounded(spark.createDataFrame([(float("nan"),)], "x double")).first().x)


def test_a_reply_computes_each_of_its_draws_once(spark, tmp_path):
    """Written out in every branch, the draws made a stage too long for the JVM to compile."""
    from tandem.sources import fixtures as fx
    spark.createDataFrame([(50, "n", "b", "t", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .write.parquet(f"{tmp_path}/part.parquet")
    r = fx.replies(spark, str(tmp_path))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 3
    assert r.count() == 60
