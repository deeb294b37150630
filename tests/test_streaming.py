"""Streaming pair counts equal the batch counts after each arriving file."""

import os
import tempfile

from tandem.operators.pairwise import canonical_pairs, pair_counts
from tandem.sources import fixtures as fx
from tandem.streaming.pair_counts import start_pair_counts
from conftest import SF001


def test_streaming_counts_match_batch(spark):
    src = tempfile.mkdtemp(prefix="tandem-stream-src-")
    ckpt = os.path.join(tempfile.mkdtemp(prefix="tandem-stream-ckpt-"), "c")
    cmp = fx.comparisons(spark, SF001)
    halves = cmp.randomSplit([0.5, 0.5], seed=7)
    halves[0].write.mode("append").parquet(src)
    q = start_pair_counts(spark, src, fx.CMP_MODELS, ckpt, "pc_test")
    try:
        q.processAllAvailable()
        halves[1].write.mode("append").parquet(src)
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("select * from pc_test").collect())
    finally:
        q.stop()
    exp = sorted(tuple(r) for r in pair_counts(canonical_pairs(cmp, fx.CMP_MODELS)).collect())
    assert got == exp
