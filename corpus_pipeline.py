"""A corpus pipeline of the training-data operators, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
``documents``. Null texts and empty tables pass through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import decontaminate, language_id, line_dedup, near_dup, packing
from tandem.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a missing ``lang`` is filled. Rejected ones (no letter,
    or a tie of two languages) go. Learned from the rows with ``lang``."""
    dicts = language_id.learn_dictionaries(docs, F.lit(True))
    got = language_id.identify(docs, dicts, carry=COLUMNS).where("not rejected")
    return got.select("carried.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in ten documents or more; ``n_chars`` counts what is left."""
    cut = line_dedup.drop_repeated_lines(docs, carry=["doc_id", "lang", "source"])
    return (cut.select("carried.*", F.col("kept").alias("text"))
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS))


def _row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_key`` of each row: its id, or a hash of id and text where the id is null or repeated, so that
    rows of one id are told apart by their text (equal rows have equal keys)."""
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    none = repeated.isEmpty()           # then the texts need not meet the list
    keyed = docs.withColumn("_again", F.lit(False)) if none else docs.join(repeated.withColumn("_again", F.lit(True)), "doc_id", "left")
    own = F.when(F.col("_again") | F.col("doc_id").isNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))
    return keyed.withColumn("_key", own).drop("_again")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (a null id comes last, ties go by a
    hash of the text). Rows of one id are documents of their own; of rows with equal id and text one stays. Texts
    without words are near nothing."""
    keyed = _row_keys(docs)
    groups = written(near_dup.near_duplicates(keyed, id="_key").select(F.col("doc_id").alias("_key"), "component_id"))
    names = keyed.select("_key", "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = groups.distinct().join(names, "_key").groupBy("component_id").agg(F.min(rank)["_key"].alias("first"))
    gone = written(groups.join(first, "component_id").where("_key <> first").select("_key").distinct())
    twice = written(groups.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))
    stay = keyed.join(gone, "_key", "left_anti")
    if twice.isEmpty():
        return stay.select(*COLUMNS)
    return stay.join(twice, "_key", "left_anti").select(*COLUMNS).unionByName(
        stay.join(twice, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage near a benchmark item; each row is judged by its own text, whatever its id."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    keyed = _row_keys(docs)
    gone = written(decontaminate.contaminated(keyed, bench, id="_key").select(F.col("doc_id").alias("_key")).distinct())
    return keyed.join(gone, "_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines),
          ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written once to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
