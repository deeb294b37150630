"""Incremental pair-outcome counts over arriving judgement files.

Judgements come in batches (one file per judged run). The count table
(noise, model_a, model_b) -> n, wins_a, wins_b, ties is all that win-rates, ties,
z-tests, average win-rates, Sigma and rank-sets need (see :mod:`tandem.operators.pairwise`),
so a streaming aggregation keeps it current; the batch operators then run on the
(tiny) result. State is one row per (noise, canonical pair): bounded by the model list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tandem.operators.pairwise import canonical_pairs, pair_counts

COMPARISON_SCHEMA = T.StructType([
    T.StructField("noise", T.StringType()), T.StructField("model_a", T.StringType()),
    T.StructField("model_b", T.StringType()), T.StructField("seed_a", T.LongType()),
    T.StructField("seed_b", T.LongType()), T.StructField("winner", T.StringType()),
])


def stream_pair_counts(spark: SparkSession, source_dir: str, models: Sequence[str], fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the running outcome counts of judgement files in ``source_dir``."""
    reader = spark.readStream.schema(COMPARISON_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return pair_counts(canonical_pairs(reader.load(source_dir), models))


def start_pair_counts(spark: SparkSession, source_dir: str, models: Sequence[str], checkpoint: str,
                      query_name: str = "pair_counts", fmt: str = "parquet"):
    """Start the aggregation into an in-memory table (complete mode) with a reliable
    checkpoint folder; returns the StreamingQuery."""
    counts = stream_pair_counts(spark, source_dir, models, fmt)
    return (counts.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint).start())
