"""Integer vectors of an embedding table, and the tiles in which a stated query set meets all rows.

A search over all rows is quadratic by its nature; it is cut into tiles of one block of queries and
one slab of rows. Both sides are dealt by a hash of the whole row, so no key makes a tile large, and
each tile is one bounded group: nothing is collected or broadcast, and a lost task repeats its tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import pick
from tandem.llm.tables import written

BLOCK_ROWS = 4096    # queries of a tile at most, on average
SLAB_ROWS = 8192     # rows of a tile, on average


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
                    **carry: str) -> DataFrame:
    """``(vec_id, v array<int>, key, *carry)`` of every row with an id and a vector of finite components:
    ``v[i] = floor(scale * x[i])`` with ``x`` as double. Rows with a null id, a null vector or any null or
    non-finite component take no part; repeated rows count once; a vector shorter than another one counts as padded
    with zeros. ``key`` tells rows of one id apart. A component beyond 32 bits raises an error."""
    rows = pick(df, vec_id=id_col, x=vec_col, **carry)
    x = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    small = lambda c: F.when(F.abs(c) < 2 ** 31, c).otherwise(F.raise_error(F.lit("vector component beyond 32 bits"))).cast("int")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    out = (rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))
           .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, small).alias("v"), *carry).distinct())
    return out.withColumn("key", F.xxhash64("v", *carry))


def tiles(queries: DataFrame, rows: DataFrame):
    """Every query with every row, grouped by (block of queries, slab of rows): a cogroup of the two sides.

    Enough tiles for the cluster's cores, none larger than the bounds above (the sizes do not change results)."""
    n_queries, n_rows = queries.count(), rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slabs = max(1, -(-n_rows // SLAB_ROWS))
    blocks = max(1, -(-n_queries // BLOCK_ROWS), min(-(-4 * cores // slabs), n_queries))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "key"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("block", deal(blocks)).withColumn("slab", spread(slabs))
    r = rows.withColumn("slab", deal(slabs)).withColumn("block", spread(blocks))
    return q.groupBy("block", "slab").cogroup(r.groupBy("block", "slab"))


def query_set(vectors: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """The written vectors and the queries among them."""
    vectors = written(vectors)
    return vectors, vectors.where(condition)


def matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of ``col`` as int64 rows, padded with zeros to ``width``."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = arr.offsets.to_numpy()
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    if (size == width).all():
        return flat.reshape(len(arr), width)
    out = np.zeros((len(arr), width), np.int64)
    out[np.repeat(np.arange(len(arr)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def pair_of_matrices(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sides' vectors at one width, and a bound on the size of their products' sums; a bound
    that a long cannot hold raises an error."""
    width = max(1, max((int(x.combine_chunks().value_lengths().to_numpy().max()) if len(x) else 0) for x in (a, b)))
    x, y = matrix(a, width), matrix(b, width)
    bound = width * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(y).max(initial=0)))
    if bound * 100 >= 2 ** 63:
        raise OverflowError("a score of these vectors may not fit a long")
    return x, y, bound
