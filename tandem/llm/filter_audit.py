"""Interaction audit of document filters in every order, by wide packed counters.

A document's failures are a bit mask. Every mask has one big integer, whose 64-bit fields
hold the document's outcome at every step of every order: kept, removed, redundant, the only failure, and
whether a good or a toxic document is lost there. The integers of a part's documents are added; a field of the sum is a
count of documents, which 64 bits hold, so no field runs into the next, and the sum unpacks into all rows.
Equal masks are counted in Spark before the shuffle, so a part sends at most 4 * 2^filters counts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import pick
from tandem.llm.tables import written

FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
LETTERS = "ABCDE"


def text_checks(text: Column) -> list[Column]:
    """Failure of the filters that see one text: under 100 words; fewer than 80 % of the words
    distinct; over 10 % capital letters A-Z; any of ``#$%&*|``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
            text.rlike(r"[#$%&*|]")]


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, n)``: documents by id and failure mask (bit i = filter i of ``LETTERS``), counted.

    The last filter fails if a smaller id has the same text (told by SHA-256) anywhere in the table. A null id has no
    smaller id, and is none: it neither fails nor makes others fail. Null texts are empty texts,
    null parts the empty part. Rows alike in all of these are counted together, so no copied row is hot.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [c.cast("int") * (1 << i) for i, c in enumerate(text_checks(text))]
    seen = written(pick(docs, doc_id=id_col, text=text_col, part=part_col)
                   .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                           F.unhex(F.sha2(text, 256)).alias("text_key"), sum(bits[1:], bits[0]).alias("mask")))
    named = seen.where("doc_id is not null").groupBy("text_key", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = (seen.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    copy = F.when(F.col("first"), 0).otherwise(1 << (len(LETTERS) - 1))
    named = named.join(first, ["text_key", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")
    unnamed = seen.where("doc_id is null").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return named.unionByName(unnamed)


def outcome_fields(n_filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders, and ``[mask, order, step, field]`` of a document that is neither good nor toxic; the last
    two fields are those of one that is both."""
    orders = list(itertools.permutations(range(n_filters)))
    out = np.zeros((1 << n_filters, len(orders), n_filters, len(FIELDS)), "<u8")
    for mask in range(1 << n_filters):
        for o, order in enumerate(orders):
            before = False
            for step, f in enumerate(order):
                fails = mask >> f & 1
                removed = fails and not before
                out[mask, o, step] = (not before and not fails, removed, fails and before, mask == 1 << f, removed, removed)
                before = before or fails
    return orders, out


class PackedCounters:
    """The big integer of every (mask, good, toxic), and the way back from their sum to counts."""

    def __init__(self, n_filters: int):
        self.orders, fields = outcome_fields(n_filters)
        self.shape = fields.shape[1:]
        self.of = {}
        for mask, good, toxic in itertools.product(range(1 << n_filters), (False, True), (False, True)):
            shown = fields[mask].copy()
            shown[..., FIELDS.index("good_lost")] *= good
            shown[..., FIELDS.index("toxic_lost")] *= toxic
            self.of[mask, good, toxic] = int.from_bytes(shown.tobytes(), "little")

    def unpack(self, total: int) -> np.ndarray:
        """``[order, step, field]`` counts of a sum of fewer than 2^63 documents' integers."""
        size = int(np.prod(self.shape)) * 8
        return np.frombuffer(total.to_bytes(size, "little"), "<u8").reshape(self.shape).astype(np.int64)


def _audit_part(letters: str):
    kept: list[PackedCounters] = []
    names = ["part", "filter_order", "step", *FIELDS, "shapley"]

    def run(counts: pa.Table) -> pa.Table:
        if not kept:
            kept.append(PackedCounters(len(letters)))
        packed = kept[0]
        total = sum(packed.of[m, g, t] * n for m, g, t, n in zip(*(counts[c].to_pylist() for c in ("mask", "good", "toxic", "n"))))
        fields = packed.unpack(total)
        orders = np.array(packed.orders)
        removed = fields[..., FIELDS.index("removed")]
        shapley = np.bincount(orders.ravel(), removed.ravel(), len(letters)).astype(np.int64) if removed.max() < 2 ** 46 else \
            np.array([int(removed[orders == f].sum()) for f in range(len(letters))])
        steps = len(letters)
        cols = [pa.array([counts["part"][0].as_py()] * orders.size, pa.string()),
                pa.array(np.repeat(["".join(letters[f] for f in o) for o in packed.orders], steps), pa.string()),
                pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))),
                *[pa.array(fields[..., i].ravel()) for i in range(len(FIELDS))], pa.array(shapley[orders.ravel()])]
        return pa.table(cols, names=names)

    return run


def audit_orders(masks: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``masks(doc_id, part, mask, n)`` and ``labels(doc_id, quality, toxic)`` -> per part, order of the filters and
    step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A document is good (toxic) if any label row of its id says 1; null ids have no label. Steps without any
    document have zeros; a table without documents gives no rows.
    """
    flags = (pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    known = masks.where("doc_id is not null").join(flags, "doc_id", "left")
    unknown = masks.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    counts = (known.unionByName(unknown)
              .groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
              .agg(F.sum("n").alias("n")))
    longs = ", ".join(f"{c} long" for c in [*FIELDS, "shapley"])
    return counts.groupBy("part").applyInArrow(_audit_part(letters), f"part string, filter_order string, step int, {longs}")
