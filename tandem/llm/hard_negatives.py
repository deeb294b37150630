"""Hard-negative mining by Four-Russians scoring.

For a few anchors at a time, the sums of all 256 subsets of their components in each group of eight
dimensions are put in tables. A candidate's components are cut into bit planes (two's complement),
and each plane's eight bits of a group are one byte: an index into that group's table. The looked-up sums of
a plane, added over the groups, are the inner product with that plane; planes are shifted and
added from the sign plane down. The scores are exact integers of every anchor with every row.

Two passes over tiles of anchors and rows: the first scores rows of the anchor's label and keeps each
anchor's best (the positives), the second scores rows of other labels and keeps, for each
positive, the best inside its window. Each pair of rows is scored in one of them, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.tables import written
from tandem.llm.vectors import integer_vectors, pair_of_matrices, query_set, tiles

ANCHORS = 128    # anchors whose tables are held at once (a table row is one cache line run)
ROWS = 1024      # candidates scored at once
GROUP = 8        # dimensions of a table; their bits are one byte


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """``[groups, 256, anchors]``: for each group of eight dimensions and each byte, the sum of the
    anchor's components whose bit is set."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    comps = np.zeros((groups * GROUP, n), kind)
    comps[:width] = anchors.T
    out = np.zeros((groups, 1 << GROUP, n), kind)
    for i in range(GROUP):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + comps[i::GROUP][:, None]
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """``[planes, groups, rows]`` bytes of the components' two's complement, the sign plane last."""
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    planes = max(high.bit_length(), (~low).bit_length() if low < 0 else 0) + 1
    bits = [np.packbits(((rows >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(planes)]
    return np.stack(bits)


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``[rows, anchors]`` inner products by table lookups, shifts and additions."""
    acc = None
    for plane in planes[::-1]:
        got = sums[0].take(plane[0], axis=0)
        for table, index in zip(sums[1:], plane[1:]):
            got += table.take(index, axis=0)
        if acc is None:
            acc = -got
        else:
            acc <<= 1
            acc += got
    return acc


def score_blocks(anchors: np.ndarray, rows: np.ndarray, bound: int) -> Iterator[tuple[slice, np.ndarray]]:
    """``(anchors, scores[rows, anchors])`` for runs of anchors."""
    kind = np.int32 if 2 * bound < 2 ** 31 else np.int64
    planes = bit_planes(rows)
    for a in range(0, len(anchors), ANCHORS):
        sums = subset_sums(anchors[a:a + ANCHORS], kind)
        yield (slice(a, min(a + ANCHORS, len(anchors))),
               np.concatenate([scores(sums, planes[:, :, r:r + ROWS]) for r in range(0, len(rows), ROWS)]))


def _labels(table: pa.Table) -> np.ndarray:
    return table["label"].to_numpy()


def _positives_of_tile(k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            a, r, bound = pair_of_matrices(anchors["v"], rows["v"])
            a_id, a_key, r_id = (t[c].to_numpy() for t, c in ((anchors, "vec_id"), (anchors, "key"), (rows, "vec_id")))
            a_lab, r_lab = _labels(anchors), _labels(rows)
            for label in np.intersect1d(a_lab, r_lab):
                at, of = np.flatnonzero(a_lab == label), np.flatnonzero(r_lab == label)
                for part, got in score_blocks(a[at], r[of], bound):
                    here = at[part]
                    low = np.iinfo(got.dtype).min
                    got[r_id[of][:, None] == a_id[here]] = low
                    best = np.argsort(-got.astype(np.int64), axis=0, kind="stable")[:k]
                    top = np.take_along_axis(got, best, 0)
                    y, x = np.nonzero(top != low)
                    found.append((a_id[here[x]], a_key[here[x]], r_id[of[best[y, x]]], top[y, x].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(cols, schema=schema)

    return run


def _negatives_of_tile(k: int, low: int, high: int):
    names = ["anchor_id", "key", "positive_id", "positive_key", "positive_score", "vec_id", "score"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            a, r, bound = pair_of_matrices(anchors["v"], rows["v"])
            a_id, a_key, r_id = (t[c].to_numpy() for t, c in ((anchors, "vec_id"), (anchors, "key"), (rows, "vec_id")))
            a_lab, r_lab = _labels(anchors), _labels(rows)
            lists = anchors["positives"].combine_chunks()
            edge = lists.offsets.to_numpy()
            each = lists.flatten()
            p_id, p_no, p_score = (each.field(c).to_numpy() for c in ("vec_id", "no", "score"))
            for label in np.unique(a_lab):
                at, of = np.flatnonzero(a_lab == label), np.flatnonzero(r_lab != label)
                if not len(of):
                    continue
                for part, got in score_blocks(a[at], r[of], bound):
                    got = got.astype(np.int64)
                    order = np.argsort(-got, axis=0, kind="stable")
                    for j, i in enumerate(at[part]):
                        best = order[:, j]
                        down = -100 * got[best, j]
                        for p in range(edge[i] - edge[0], edge[i + 1] - edge[0]):
                            lo = np.searchsorted(down, -high * p_score[p], "left")
                            hi = min(np.searchsorted(down, -low * p_score[p], "right"), lo + k)
                            if lo < hi:
                                n = hi - lo
                                found.append((np.full(n, a_id[i]), np.full(n, a_key[i]), np.full(n, p_id[p]), np.full(n, p_no[p]),
                                              np.full(n, p_score[p]), r_id[of[best[lo:hi]]], got[best[lo:hi], j]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table(cols, schema=schema)

    return run


def hard_negatives(df: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are its ``positives`` rows of highest score among
    the other rows of its label; for each of them, the ``negatives`` highest-scoring rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned. Scores
    are integer inner products of ``floor(scale * x)``; ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Empty vectors
    are zero vectors; a shorter vector counts as padded with zeros. Repeated rows count once; rows of one id with other vectors or
    labels are rows of their own, never positives or negatives of their own id. A positive without a
    negative gives no row; an empty table gives none. Other columns of ``df`` are left behind.
    """
    rows = integer_vectors(df.where(df[label_col].isNotNull()), id_col, vec_col, scale, label=label_col)
    rows, anchors = query_set(rows.withColumn("label", F.col("label").cast("long")), is_anchor)

    by_score = [F.desc("score"), F.asc("vec_id")]
    near = (tiles(anchors, rows).applyInArrow(_positives_of_tile(positives), "anchor_id long, key long, vec_id long, score long")
            .withColumn("no", F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(*by_score)))
            .where(F.col("no") <= positives))
    near = near.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(
        F.collect_list(F.struct("vec_id", F.col("no").cast("long").alias("no"), "score")).alias("positives"))
    with_positives = written(anchors.join(near, ["vec_id", "key"]))

    far = tiles(with_positives, rows).applyInArrow(
        _negatives_of_tile(negatives, low, high),
        "anchor_id long, key long, positive_id long, positive_key long, positive_score long, vec_id long, score long")
    place = Window.partitionBy("anchor_id", "key", "positive_key").orderBy(*by_score)
    return (far.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
