"""ordinal(): range-partitioned numbering equals a plain window, hot groups included."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.operators.indexing import ordinal


def test_ordinal_matches_window(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.4 else f"g{random.randint(0, 30)}", random.randint(0, 300), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")   # many batches per task
    try:
        got = ordinal(df, ["g"], ["v", "id"], "o").select("id", "o").collect()
        dense = ordinal(df, ["g"], ["v"], "d", dense=True, base=1).select("id", "d").collect()
        glob = ordinal(df, [], ["v", "id"], "p").select("id", "p").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = {r.id: r.o for r in df.select("id", (F.row_number().over(w) - 1).alias("o")).collect()}
    assert {r.id: r.o for r in got} == exp
    expd = {r.id: r.d for r in df.select("id", F.dense_rank().over(Window.partitionBy("g").orderBy("v")).alias("d")).collect()}
    assert {r.id: r.d for r in dense} == expd
    expg = {r.id: r.p for r in df.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("p")).collect()}
    assert {r.id: r.p for r in glob} == expg


def test_null_keys_and_wide_numbers_survive(spark):
    rows = [(None, 3, 9007199254740993, None), (None, 1, None, "x"), ("a", 2, 9007199254740993, None),
            ("a", None, 1, "y"), ("b", 5, None, None)]
    df = spark.createDataFrame(rows, "g string, o long, v long, t string")
    out = ordinal(df, ["g"], ["o"], "i", partitions=3)
    assert out.schema["v"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, 3, 9007199254740993, None, 1), (None, 1, None, "x", 0), ("a", 2, 9007199254740993, None, 1),
         ("a", None, 1, "y", 0), ("b", 5, None, None, 0)], key=str)
    dense = ordinal(df.unionByName(df), ["g"], ["o"], "i", dense=True)
    assert sorted((r.g or "", r.o or 0, r.i) for r in dense.collect()) == sorted(2 * [("", 3, 1), ("", 1, 0), ("a", 2, 1), ("a", 0, 0), ("b", 5, 0)])
    assert ordinal(df.limit(0), ["g"], ["o"], "i").count() == 0
