"""Vocabulary statistics and the joint vocabulary.

Input: long vocabulary table (model, mrank, token, token_id), one row per token of
each model. Nothing is collected per token or per model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.indexing import ordinal
from tandem.session import ship_package


def vocab_size(vocab: DataFrame) -> DataFrame:
    """A1: number of tokens per model."""
    return vocab.groupBy("mrank", "model").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


_WORD = 63      # models per word of a bit set (its sign bit stays 0)


def token_masks(vocab: DataFrame, n_models: int) -> DataFrame:
    """Per token, the bit set of the models that have it, in as many words ``w0``, ``w1``, ... as ``n_models`` need."""
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast(mrank % {_WORD} as int))")
    word = F.floor(F.col("mrank") / _WORD)
    return vocab.groupBy("token").agg(*[F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0)).alias(f"w{w}")
                                        for w in range(max(1, -(-n_models // _WORD)))])


def _common_of_masks(k: int):
    def run(batches):
        """One k x k count matrix per task: masks as 0/1 rows, weighted by their number of tokens."""
        total = np.zeros((k, k), np.int64)
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy() for w in range(batch.num_columns - 1)], 1)
            has = (words[:, np.arange(k) // _WORD] >> (np.arange(k) % _WORD) & 1).astype(np.float64)
            counted = has * batch.column(batch.num_columns - 1).to_numpy()[:, None]
            total += np.rint(counted.T @ has).astype(np.int64)          # counts of a batch: exact in a double
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "common": total[i, j]})

    return run


def vocab_common(vocab: DataFrame, models: Sequence[str]) -> DataFrame:
    """A2 + J7 + T1: size of the intersection of every pair of vocabularies (i < j), for any number of models.

    Instead of a token self-join, each token gets the bit set of its models; equal bit sets are counted, and every task
    adds its bit sets up to one count per pair, so k (k - 1) / 2 rows a task are shuffled, never a row per token and pair."""
    k = len(models)
    ship_package(vocab.sparkSession)
    masks = token_masks(vocab, k)
    words = [c for c in masks.columns if c != "token"]
    per_mask = masks.groupBy(*words).agg(F.count(F.lit(1)).alias("cnt"))
    partial = per_mask.mapInArrow(_common_of_masks(k), "i int, j int, common long")
    name = F.array(*[F.lit(m) for m in models]).cast("array<string>")
    pair = vocab.sparkSession.range(max(k - 1, 0)).select("id", F.explode(F.sequence(F.col("id") + 1, F.lit(max(k, 1) - 1).cast("long"))).alias("j"))
    none = pair.select(F.col("id").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.lit(0).cast("long").alias("common"))
    return partial.unionByName(none).groupBy("i", "j").agg(F.sum("common").cast("bigint").alias("common")) \
        .select(F.element_at(name, F.col("i") + 1).alias("model1"), F.element_at(name, F.col("j") + 1).alias("model2"), "common")


def vocab_union(vocab: DataFrame) -> DataFrame:
    """Distinct tokens over all vocabularies."""
    return vocab.select("token").distinct()


def joint_vocab(vocab: DataFrame) -> DataFrame:
    """W1 + W8: joint id of every distinct token, dense from 0, by first appearance when
    the vocabularies are read in model order, each sorted by its own token id.

    The numbering is a range-partitioned sort with per-partition offsets, so no single
    task sees the whole vocabulary."""
    first = vocab.groupBy("token").agg(F.min(F.struct("mrank", "token_id")).alias("f")) \
        .select("token", F.col("f.mrank").alias("first_rank"), F.col("f.token_id").alias("first_id"))
    return ordinal(first, [], ["first_rank", "first_id"], "joint_id").select("token", "joint_id")


def joint_lookup(vocab: DataFrame, joint: DataFrame) -> DataFrame:
    """Model token id <-> joint id, both directions from one equi-join on the token."""
    return vocab.join(joint, "token").select("model", "mrank", "token_id", "joint_id")
