"""Connected components of an edge table by repeated contraction.

Each round every node points to the first of itself and its neighbours in a random (hashed) order;
edges are rewritten to the pointed-to nodes, and loops and repeats vanish. Hashing the order makes
every graph, long paths included, shrink by a constant factor a round on average, so the rounds
grow with the logarithm of the graph. Degrees do not matter: the first neighbour is combined
before the shuffle and the joins' other side has one row per node, so a hot node's edges can be
split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node with an edge to another node;
    ``component`` is the smallest node reachable. Null ends and loops are ignored."""
    live = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                   .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("up"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("up"))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min(order).alias("m"))
                     .select("node", F.least("m", own)["up"].alias("up")))
        steps.append(to)
        left = live.join(to.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        moved = left.join(to.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        live = written(moved.where("ua <> ub")
                       .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0].select("node", F.col("up").alias("root"))
    for to in steps[1:]:
        out = out.join(to.select(F.col("node").alias("root"), "up"), "root", "left") \
            .select("node", F.coalesce("up", "root").alias("root"))
    out = written(out)
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
