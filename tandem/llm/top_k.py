"""Exact top-k search by no-random-access aggregation.

A tile's rows are held as one sorted list per dimension. For a query, each list is read in the
direction in which its term ``q[d] * x[d]`` falls. What has been read of a row gives its known part; an
unread term is at most the list's front (the term read last) and at least the list's last term, so
every row has an upper and a lower score bound. Rows whose upper bound is below the k-th lower bound
are out; reading stops when no more rows are left than one further slice of a list holds, and the
final scores of those are resolved. Rows never met in any list are bounded by the sum of the fronts like all others.
Queries of a block read a slice together: its terms are one matrix product, and so are the bounds.

Each tile gives its own exact top k of every query; a ranked merge over tiles gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.vectors import integer_vectors, pair_of_matrices, query_set, tiles

QUERIES = 128    # queries that read the lists together
SLICES = 4       # parts in which a list is read; reading stops when no more than one part of the rows is left


class SortedLists:
    """The rows of a tile as one list per dimension, ascending."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids, self.n = rows, ids, len(ids)
        order = np.argsort(rows, axis=0, kind="stable")
        self.value = np.take_along_axis(rows, order, 0).astype(np.float64)        # [place, dimension]
        self.place = np.empty(order.shape, np.int32)                              # [row, dimension]
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, slices: int = SLICES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For every query: its number, the rows and scores of its ``k`` best other than id ``own``,
        and the depth to which its lists were read."""
        n, step, depth = self.n, max(1, -(-self.n // slices)), 0
        rise, fall = np.maximum(queries, 0).T.astype(np.float64), np.minimum(queries, 0).T.astype(np.float64)
        number = np.arange(len(queries))
        alive = self.ids[:, None] != own[None]
        known = np.zeros(alive.shape)
        while len(number):
            if depth < n and n > k:
                to = min(depth + step, n)
                # the next slice of every list: from its large end for weights over zero, from its small end for others
                high = (self.place >= n - to) & (self.place < n - depth)
                low = (self.place >= depth) & (self.place < to)
                known += (self.rows * high) @ rise + (self.rows * low) @ fall
                depth = to
                above, below = (self.place < n - depth).astype(np.float64), (self.place >= depth).astype(np.float64)
                upper = known + above @ (rise * self.value[n - depth][:, None]) + below @ (fall * self.value[depth - 1][:, None])
                lower = known + above @ (rise * self.value[0][:, None]) + below @ (fall * self.value[-1][:, None])
                lower[~alive] = -np.inf
                alive &= upper >= np.partition(lower, n - k, axis=0)[n - k]
            else:
                depth = n
            done = (alive.sum(0) <= max(k, step)) | (depth >= n)
            for j in np.flatnonzero(done):
                left = np.flatnonzero(alive[:, j])
                score = self.rows[left] @ queries[number[j]]
                best = np.lexsort((self.ids[left], -score))[:k]
                yield int(number[j]), left[best], score[best], depth
            go = ~done
            number, alive, known, rise, fall = number[go], alive[:, go], known[:, go], rise[:, go], fall[:, go]


def _top_of_tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            q, r, bound = pair_of_matrices(queries["v"], rows["v"])
            if bound >= 2 ** 53:
                raise OverflowError("score bounds of these vectors are not exact in double precision")
            q_id, q_key, r_id = (t[c].to_numpy() for t, c in ((queries, "vec_id"), (queries, "key"), (rows, "vec_id")))
            lists = SortedLists(r, r_id)
            for a in range(0, len(q), QUERIES):
                for i, at, score, _ in lists.top(q[a:a + QUERIES], q_id[a:a + QUERIES], k):
                    found.append((np.full(len(at), q_id[a + i]), np.full(len(at), q_key[a + i]), r_id[at], score))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(cols, schema=schema)

    return run


def top_k(df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of highest integer inner product with each query.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows of other ids. Scores are inner
    products of ``floor(scale * x)``; ties go to the smaller id; all candidates are returned where there are fewer than ``k``.

    Rows with a null id or vector, or a null or non-finite component, take no part. Empty vectors are zero vectors; a
    shorter vector counts as padded with zeros. Repeated rows count once; rows of one id with
    other vectors are queries and candidates of their own. An empty table, or one without queries, gives no
    rows. Other columns of ``df`` are left behind.
    """
    rows, queries = query_set(integer_vectors(df, id_col, vec_col, scale), is_query)
    found = tiles(queries, rows).applyInArrow(_top_of_tile(k), "query_id long, key long, vec_id long, score long")
    place = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
