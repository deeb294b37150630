"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat log often stores a conversation again after every turn. Each turn gets a rolling hash of
the turns up to it (an XOR of position-salted hashes, two 64-bit lanes); a conversation whose full
hash is the hash of an inner turn of another is a snapshot of it and goes by an anti-join. Equal
conversations keep the smallest id. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.arrow import pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(own, conv_id, pos, role, text, h1, h2, last)``: the turns in order with rolling hashes.

    One shuffle, by conversation. ``own`` names the conversation: its id, or for turns without one
    a hash of the turn.
    """
    rows = pick(log, conv_id=conv, turn=turn, role=role, text=text)
    own = F.when(F.col("conv_id").isNull(), F.concat(F.lit("?"), F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("turn").cast("string"), F.lit("\x1e")),
                 F.coalesce("role", F.lit("\x1e")), F.coalesce("text", F.lit("\x1e"))), 256))).otherwise(F.col("conv_id").cast("string"))
    rows = rows.withColumn("own", own)
    order = Window.partitionBy("own").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    again = [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")]
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("again", (F.col("n") > 1) & again[0] & again[1] & again[2])
    rows = rows.where("not again").withColumn("pos", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return rows.select("own", "conv_id", "pos", "role", "text",
                       F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(upto).alias("h1"),
                       F.bit_xor(F.xxhash64(F.lit(2), *parts)).over(upto).alias("h2"),
                       F.lead("pos").over(order).isNull().alias("last"))


def format_chats(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, n_turns, n_copies, chat)`` for every maximal conversation.

    A conversation is its turns by ``turn`` (null first; ties by role, then text); equal rows of it
    count once. It is dropped if its turns are the first turns of a longer one, or those of an
    equal one with a smaller id; ``n_copies`` counts the equal ones. Turns compare by role and text,
    null unlike empty. A turn without a conversation id is a conversation of its own, with a null
    id; it comes after real ids among equals. A null role or text is rendered as empty. An empty
    log gives no rows. A rendered conversation is one value, so its turns meet in one task;
    equal conversations, however many, are merged before any of them is rendered.
    """
    t = turns(log, conv, turn, role, text)
    full = (t.where("last").groupBy("h1", "h2", F.col("pos").alias("n_turns"))
            .agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "own")).alias("first"), F.count("*").alias("n_copies")))
    inner = t.where("not last").select("h1", "h2", F.col("pos").alias("n_turns")).distinct()
    maximal = full.join(inner, ["h1", "h2", "n_turns"], "left_anti") \
        .select(F.col("first.own").alias("own"), "n_turns", "n_copies")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    kept = t.select("own", "conv_id", F.struct("pos", said.alias("said")).alias("t")).join(maximal, "own")
    return (kept.groupBy("own", "conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("ts"))
            .select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("ts.said"), "").alias("chat")))
