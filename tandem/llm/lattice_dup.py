"""Embedding near-duplicates by E8 lattice hashing.

Each table projects unit vectors by a random Gaussian map to eight dimensions and decodes the
point to the nearest point of the E8 lattice; the nearest of the 240 neighbouring lattice points
are probed too. Vectors that share a cell in any table are candidates, verified by their exact
cosine in double precision.

Cells are compared as matrices: a cell's members meet in blocks, never as a table of pairs. A pair
is counted in the smallest cell it shares, so partial link counts add up; a block sends on one
row a member (its count and its smallest linked vector), whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import pick
from tandem.llm.components import components
from tandem.llm.words import mix
from tandem.llm.tables import written

BLOCK = 512


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) in any places, and halves with an even number of minus signs."""
    out = [np.bincount([i, j], [a, b], 8) for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    f = np.rint(y)
    e = y - f
    odd = np.flatnonzero(f.sum(1) % 2)
    worst = np.abs(e[odd]).argmax(1)
    f[odd, worst] += np.where(e[odd, worst] >= 0, 1, -1)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer one of D8 and D8 shifted by one half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and which rows have a length (finite, not zero)."""
    v = v.astype(np.float64)
    top = np.abs(v).max(1, initial=0)
    ok = np.isfinite(v).all(1) & (top > 0)
    v = np.where(ok[:, None], v, 0) / np.where(ok, top, 1)[:, None]
    return v / np.sqrt(np.where(ok, (v * v).sum(1), 1))[:, None], ok


def cell_codes(u: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """``(n, tables * probes)`` 64-bit codes of the probed cells of unit vectors ``u``."""
    roots = e8_roots()
    out = []
    for t in range(tables):
        to = np.random.default_rng([seed, u.shape[1], t]).normal(size=(u.shape[1], 8)) / scale
        y = u @ to
        home = nearest_e8(y)
        order = np.argsort(-((y - home) @ roots.T), axis=1, kind="stable")[:, :probes - 1]
        for cell in [home, *(home + roots[order[:, k]] for k in range(probes - 1))]:
            code = np.full(len(u), t * 4096 + u.shape[1], np.uint64)
            for c in np.rint(cell * 2).astype(np.int64).view(np.uint64).T:
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + c)
            out.append(code)
    return np.stack(out, 1).view(np.int64)


def _compare(a: dict, b: dict | None, cell: int, least: float):
    """Links among the members of block ``a``, or between ``a`` and ``b``, of one cell:
    (node, partial link count, smallest linked node) per member with a link."""
    n = len(a["node"])
    m = a if b is None else {k: np.concatenate([a[k], b[k]]) for k in a}
    s = a["unit"] @ (a if b is None else b)["unit"].T >= least
    if b is None:
        np.fill_diagonal(s, False)
    if not s.any():
        return None
    adj = s if b is None else np.block([[np.zeros((n, n), bool), s], [s.T, np.zeros((len(m["node"]) - n,) * 2, bool)]])
    low = np.where(m["cells"] < cell, m["cells"], cell)     # a smaller common cell counts the pair
    values, at = np.unique(low, return_inverse=True)
    at = at.reshape(low.shape)
    has = np.zeros((len(m["node"]), len(values)), np.float32)
    np.put_along_axis(has, at, 1, 1)
    has[:, values == cell] = 0
    has = has[:, has.sum(0) > 1]
    count = ((adj & (has @ has.T == 0)) * m["mult"]).sum(1)
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label, len(adj)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    live = adj.any(1)
    return m["node"][live], count[live], m["node"][label][live]


def linked_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9,  # noqa: A002
                   tables: int = 5, probes: int = 6, scale: float = 1.3, seed: int = 7) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: links are pairs of cosine >= ``least`` found.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths neither. Equal vectors are one class and link with each other.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable. A null id takes no part in it: such a row's component is null unless a linked row has an
    id, and it is kept. Repeated ids are vectors of their own; an empty table gives no rows.

    A pair is missed only if no table puts it in a common cell: with the defaults about one in a
    thousand at cosine 0.9, far fewer above (tests/llm measures recall). A smaller ``scale``
    makes cells smaller, for larger tables; more ``tables`` and ``probes`` make up for it.
    """
    rows = pick(vectors, id=id, v=vector).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    good = ("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
            " and exists(v, x -> x <> 0)")
    rows = rows.withColumn("node", F.when(F.expr(good), F.xxhash64("v"))) \
        .withColumn("check", F.when(F.col("node").isNotNull(), F.xxhash64(F.lit(1), "v")))
    classes = (rows.where("node is not null").groupBy("node", "check")
               .agg(F.count("*").alias("mult"), F.any_value("v").alias("v")))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                lens = p.column(2).value_lengths().to_numpy()
                for n in np.unique(lens):
                    q = p.filter(pa.array(lens == n))
                    u, ok = unit(q.column(2).flatten().to_numpy().reshape(-1, n))
                    got = np.sort(cell_codes(u, tables, probes, scale, seed), axis=1)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.int64()))
                    yield pa.record_batch([q.column(0), q.column(1), pa.array([x.tobytes() for x in u], pa.binary()), lists],
                                          names=["node", "mult", "unit", "cells"])

    coded = written(classes.select("node", "mult", "v").mapInArrow(codes, "node long, mult long, unit binary, cells array<long>"))
    each = coded.select("node", "mult", "unit", "cells", F.explode(F.array_distinct("cells")).alias("cell"))
    crowd = (each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
             .select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")))
    dealt = (each.join(crowd, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                     "node", "mult", "unit", "cells"))
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table, last: bool):
            if not t.num_rows:
                return [], t
            keys = np.stack([t[c].to_numpy() for c in ("cell", "i", "j")], 1)
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            end = t.num_rows if last else int(starts[-1])
            if not end:
                return [], t
            node, mult, own = (t[c].to_numpy()[:end] for c in ("node", "mult", "own"))
            units = t["unit"].to_pylist()[:end]
            cells = t["cells"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[:end]
            out = []
            for x, y in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if y > end or y - x < 2:
                    continue
                if len({len(w) for w in units[x:y]}) > 1:
                    continue  # codes hold the length: a chance collision
                m = {"node": node[x:y], "mult": mult[x:y], "cells": cells[x:y],
                     "unit": np.frombuffer(b"".join(units[x:y])).reshape(y - x, -1)}
                i, j = keys[x, 1], keys[x, 2]
                if i == j:
                    got = _compare(m, None, keys[x, 0], least)
                else:
                    side = own[x:y] == i
                    if side.all() or not side.any():
                        continue
                    got = _compare({k: v[side] for k, v in m.items()}, {k: v[~side] for k, v in m.items()}, keys[x, 0], least)
                if got:
                    out.append(got)
            return out, t.slice(end)

        def batch(found):
            cols = [np.concatenate(c) for c in zip(*found, strict=True)]
            return pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], names=["node", "links", "to"])

        for b in batches:
            held.append(b)
            found, rest = flush(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            if found:
                yield batch(found)
        if held:
            found, _ = flush(pa.Table.from_batches(held).combine_chunks(), True)
            if found:
                yield batch(found)

    part = written(dealt.mapInArrow(compare, "node long, links long, to long"))
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(part.select(F.col("node").alias("a"), F.col("to").alias("b")))
    sized = classes.select("node", "mult")
    smallest = (rows.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
                .join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    root = smallest.groupBy("component").agg(F.min("low").alias("component_id"))
    info = (sized.groupBy("node").agg(F.sum("mult").alias("mult")).join(links, "node", "left")
            .join(smallest.join(root, "component").select("node", "component_id"), "node")
            .select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", "node").join(info, "node", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
