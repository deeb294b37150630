"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tandem.session import checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later plans neither
    recompute it nor depend on the executors that made it, and see its true size (a checkpointed
    DataFrame keeps the size estimate of the plan it cut, which grows with every join in a loop)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tandem-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
