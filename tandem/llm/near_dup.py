"""MinHash near-duplicates with odd sketches.

``bands * rows`` MinHash samples of each document's distinct word shingles give the band keys
that propose candidates; the same samples, each toggling one bit of a parity bitmap (an *odd
sketch*), estimate high similarities from the popcount of the XOR and reject poor candidates;
the rest are confirmed on the full shingle sets.

Equal sets form one class, represented by its smallest id. In a band bucket every member is
paired with one hashed centre (linear, whatever the bucket's size); verified links are contracted
to components; then the pairs of different components are verified too: those of a star one by one,
those that a star left out in blocks. Pairs inside one component need no check, so a group of near copies costs
about one verification a member, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.arrow import pick, small_slices
from tandem.llm.components import components
from tandem.llm.words import mix, shingles, split_words
from tandem.llm.tables import written

_U = np.uint64
BLOCK = 512


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def sketch_batch(texts: pa.Array, k: int, bands: int, rows: int, sketch_bits: int):
    """Per text: set size, two 64-bit set signatures, band keys and odd sketch words.

    Signatures are sums of mixed shingle hashes over the distinct set: equal sets, equal sums.
    A text without words has size 0 and zero arrays.
    """
    s, at = shingles(split_words(texts, lower=True), k)
    n = len(at) - 1
    size, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    uniq = []
    for d in np.flatnonzero(np.diff(at)):
        u = np.unique(s[at[d]:at[d + 1]])
        uniq.append(u)
        size[d] = len(u)
    live = np.flatnonzero(size)
    samples = bands * rows
    sig = np.zeros((n, samples), np.uint64)
    words = np.zeros((n, sketch_bits // 64), np.uint64)
    keys = np.zeros((n, bands), np.uint64)
    if len(live):
        u = np.concatenate(uniq)
        start = np.concatenate([[0], np.cumsum(size[live])[:-1]])
        s1[live] = np.add.reduceat(mix(u ^ _U(0x5851F42D4C957F2D)), start)
        s2[live] = np.add.reduceat(mix(u ^ _U(0x14057B7EF767814F)), start)
        for i, c in enumerate(_coefficients(samples)):
            sig[live, i] = np.minimum.reduceat(u * c + (c >> _U(7)), start)
        m = sig[live]
        bit = (mix(m ^ (np.arange(samples, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))) % _U(sketch_bits)).astype(np.int64)
        flat = np.repeat(np.arange(len(live)), samples) * sketch_bits + bit.ravel()
        odd = (np.bincount(flat, minlength=len(live) * sketch_bits) & 1).astype(np.uint8)
        words[live] = np.packbits(odd.reshape(len(live), sketch_bits), axis=1).view(np.uint64)
        key = np.zeros((len(live), bands), np.uint64)
        for r in range(rows):
            key = mix(key * _U(0xD6E8FEB86659FD93) + m[:, r::rows])
        keys[live] = key + np.arange(bands, dtype=np.uint64)
    return size, s1, s2, keys, words


def _long_lists(a: np.ndarray) -> pa.Array:
    n, m = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)),
                                    pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))


def sketch_table(docs: DataFrame, k: int, bands: int, rows: int, sketch_bits: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, s1, s2, bands, sketch)``, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 1):
            size, s1, s2, keys, words = sketch_batch(b.column(1), k, bands, rows, sketch_bits)
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                                   _long_lists(keys), _long_lists(words)],
                                  names=["doc_id", "n", "s1", "s2", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs(rep, text, s1, s2)`` -> ``(rep, shingles)`` for the rows whose set has that signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 1):
            s, at = shingles(split_words(b.column(1), lower=True), k)
            sets = [np.unique(s[x:y]) for x, y in zip(at, at[1:], strict=False)]
            same = [mix(u ^ _U(0x5851F42D4C957F2D)).sum().view(np.int64) == i and mix(u ^ _U(0x14057B7EF767814F)).sum().view(np.int64) == j
                    for u, i, j in zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = np.flatnonzero(same)
            yield pa.record_batch([b.column(0).take(pa.array(keep)),
                                   pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                                  names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles array<long>")


def _max_xor(samples: int, bits: int, threshold: float, spread: float) -> int:
    """Largest XOR popcount kept: the expected one ``spread`` standard deviations of the sample
    count below ``threshold`` (a lost pair is a chance of under 1e-6 at 5)."""
    apart = samples * (1 - threshold) + spread * (samples * threshold * (1 - threshold)) ** 0.5
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * apart)) + spread)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75,  # noqa: A002
                    bands: int = 32, rows: int = 4, sketch_bits: int = 512) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: components of the documents whose
    shingle sets have ``100 * intersection >= percent * union``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set is the distinct ``k``-word shingles,
    of a shorter text its whole sequence. Null or wordless texts have no set and link with nothing.
    ``component_id`` is the smallest id reachable, the row's own id without links; ``kept`` says
    they are equal. Rows that share an id are one node, also if their texts differ or some are empty. A null id links with nothing, has a null
    component and is kept. An empty table gives no rows. Two documents at similarity ``s`` share a
    band with probability ``1 - (1 - s^rows)^bands``: 0.999995 at 0.75 with the defaults, and each
    link of a group has many ways to be found.
    """
    base = pick(docs.withColumn(id, F.col(id).cast("long")), doc_id=id, text=text)
    table = written(sketch_table(base, k, bands, rows, sketch_bits))
    reps = written(table.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2")
                       .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    # an id in several classes (or with and without a set) links them
    kind = F.struct("n", "s1", "s2")
    several = (table.where("doc_id is not null").groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi"))
               .where("lo <> hi").select("doc_id"))
    same_id = (table.join(several, "doc_id").join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
               .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    comp = _link(base, reps, k, percent, bands * rows, sketch_bits, same_id)
    members = (table.join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
               .withColumn("node", F.coalesce("rep", "doc_id")).join(comp, "node", "left"))
    return members.select("doc_id", F.col("n").alias("n_shingles"),
                          F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _link(base: DataFrame, reps: DataFrame, k: int, percent: int, samples: int, bits: int, given: DataFrame) -> DataFrame:
    """``(node, component)`` over the class representatives that have a link, those of ``given(a, b)`` included."""
    keyed = reps.select(F.col("rep").alias("r"), F.explode("bands").alias("key"))
    centres = (keyed.groupBy("key").agg(F.count("*").alias("size"),
                                        F.min(F.struct(F.xxhash64("r", "key"), F.col("r").alias("r"))).alias("c"))
               .where("size > 1").select("key", "size", F.col("c.r").alias("c")))
    member = written(keyed.join(centres, "key"))
    worst = _max_xor(samples, bits, percent / 100, 5.0)

    def near(pairs: DataFrame) -> DataFrame:
        light = reps.select("rep", "n", "sketch")
        both = (pairs.join(light.toDF("a", "na", "ka"), "a").join(light.toDF("b", "nb", "kb"), "b")
                .withColumn("x", F.aggregate(F.zip_with("ka", "kb", lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                                             F.lit(0), lambda s, v: s + v)))
        return both.where(f"x <= {worst} and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "x")

    star = written(near(member.where("r <> c").select(F.least("r", "c").alias("a"), F.greatest("r", "c").alias("b")).distinct()))
    wanted = member.select(F.col("r").alias("rep")).distinct().join(reps.select("rep", "s1", "s2"), "rep")
    sets = written(shingle_sets(wanted.join(base, wanted["rep"] == base["doc_id"]).select("rep", "text", "s1", "s2"), k))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a")
        both = left.join(sets.toDF("b", "sb"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs of different components, with them as ``ca`` and ``cb``."""
        both = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
        return (both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb"))

    # the nearest few pairs of each document join most groups; a window limit of this size is applied before the shuffle
    ends = star.select("a", "b", "x", F.explode(F.array("a", "b")).alias("end"))
    order = Window.partitionBy("end").orderBy("x", "a", "b")
    first = ends.withColumn("r", F.row_number().over(order)).where("r <= 3").select("a", "b").distinct()
    links = written(verified(first).unionByName(given))
    comp = components(links)
    rest = apart(star, comp).select("a", "b").join(first, ["a", "b"], "left_anti")
    more = written(verified(rest).unionByName(_left_out(member, reps, sets, comp, worst, percent)))
    return comp if more.isEmpty() else components(links.unionByName(more))


def _left_out(member: DataFrame, reps: DataFrame, sets: DataFrame, comp: DataFrame, worst: int, percent: int) -> DataFrame:
    """Links among the members of a bucket other than its centre, of different components.

    Only buckets of three or more with more than one component matter. A bucket is dealt in blocks
    of about ``BLOCK`` members, so a large one is many block pairs, each a small task of its own. In a
    block the sketches choose the pairs and the full sets confirm them, all at once; what it
    sends on is one link a member at most (to the smallest of those it is connected with), never
    its pairs.
    """
    placed = (member.where("size > 2").join(comp.toDF("r", "comp"), "r", "left")
              .withColumn("comp", F.coalesce("comp", "r")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = (placed.where("r <> c").join(mixed, "key").join(reps.select(F.col("rep").alias("r"), "n", "sketch"), "r")
            .join(sets.toDF("r", "shingles"), "r")
            .withColumn("g", F.ceil(F.col("size") / BLOCK).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("r"), F.col("g")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "r", "comp", "n", "sketch", "shingles"))

    def compare(t: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()        # of the blocks before this one
        t = t.combine_chunks()
        r, comp_, n, own, i, j = (t[x].to_numpy() for x in ("r", "comp", "n", "own", "i", "j"))
        sk = t["sketch"].chunk(0).flatten().to_numpy().reshape(len(r), -1).view(np.uint64)
        near = np.zeros((len(r), len(r)), bool)
        for x in np.flatnonzero(own == i[0]):
            y = np.flatnonzero((comp_ != comp_[x]) & (own == j[0]))
            y = y[np.bitwise_count(sk[y] ^ sk[x]).sum(1) <= worst]
            near[x, y] = 100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])
        near |= near.T
        live = np.flatnonzero(near.any(1))
        near, n, r = near[np.ix_(live, live)], n[live], r[live]
        common = _common_counts([t["shingles"].chunk(0)[int(x)].values.to_numpy() for x in live])
        link = near & (100 * common >= percent * (n[:, None] + n[None, :] - common))
        label = np.arange(len(r))
        while len(r):
            new = np.minimum(label, np.where(link, label, len(r)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(r[label] != r)
        return pa.table({"a": np.minimum(r[far], r[label[far]]), "b": np.maximum(r[far], r[label[far]])})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _common_counts(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of incidence matrices."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if sets:
        u, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = np.flatnonzero(count > 1)
        place = np.full(len(u), -1)
        place[shared] = np.arange(len(shared))
        at = place[at]
        for lo in range(0, len(shared), columns):
            own = (at >= lo) & (at < lo + columns)
            m = np.zeros((len(sets), min(columns, len(shared) - lo)), np.float32)
            m[owner[own], at[own] - lo] = 1
            out += m @ m.T
    return out.astype(np.int64)
