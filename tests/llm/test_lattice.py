"""Lattice hashing: decoding against brute force, recall, links and components."""

import numpy as np
import pytest

from tandem.llm.lattice_dup import cell_codes, e8_roots, linked_vectors, nearest_e8, unit


def test_nearest_point_and_roots():
    roots = e8_roots()
    assert roots.shape == (240, 8) and len(np.unique(roots, axis=0)) == 240 and np.allclose((roots ** 2).sum(1), 2)
    rng = np.random.default_rng(0)
    y = rng.normal(size=(3000, 8)) * 2
    p = nearest_e8(y)
    twice = np.rint(p * 2).astype(int)
    assert np.allclose(twice / 2, p) and ((twice % 2).sum(1) % 8 == 0).all() and (p.sum(1) % 2 == 0).all()
    assert (((y - p) ** 2).sum(1) <= 1 + 1e-9).all()                      # covering radius 1
    near = ((y[:, None] - p[:, None] - roots[None]) ** 2).sum(2).min(1)     # no neighbour is nearer
    assert (((y - p) ** 2).sum(1) <= near + 1e-9).all()


@pytest.mark.parametrize(("cosine", "least"), [(0.9, 0.99), (0.93, 0.998), (0.97, 0.9999)])
def test_recall(cosine, least):
    rng = np.random.default_rng(1)
    x, _ = unit(rng.normal(size=(6000, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = cosine * x + (1 - cosine ** 2) ** 0.5 * unit(z)[0]
    a, b = (cell_codes(v, 5, 6, 1.3, 7) for v in (x, y))
    hit = (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert hit.mean() >= least
    far = (a[:, :, None] == np.roll(b, 1, 0)[:, None, :]).any((1, 2))
    assert far.mean() < 0.06


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        u, _ = unit(np.array([rows[i][1] for i in own]))
        s = u @ u.T >= 0.9
        for a, b in zip(*np.nonzero(s), strict=True):
            if a != b:
                links[own[a]] += 1
                up[find(own[a])] = find(own[b])
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 60), d if d is not None else 1 << 60)
    return sorted((str(d), links[i], str(low[find(i)] if low[find(i)] < 1 << 60 else None),
                   d is None or low[find(i)] in (d, 1 << 60)) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def test_groups_copies_and_invalid(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for size, noise in ((700, 0.02), (40, 0.03), (5, 0.01), (1, 0)):        # the first fills several blocks
        c = rng.normal(size=32)
        for _ in range(size):
            rows.append((n, (c / np.linalg.norm(c) + noise * rng.normal(size=32)).tolist()))
            n += 1
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, (np.array(rows[3][1]) * 1e-30).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [None] + [1.0] * 31), (3004, [float("nan")] * 32), (3005, [float("inf")] * 32),
             (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1.0]), (3009, [-1.0]), (3010, [5.0]), (None, [1.0, 2.0]), (None, [0.0])]
    rows += [(4000, [1.0, 0.0, 0.0]), (4000, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as mult", "3 as v").repartition(4)
    want = [r for r in brute(rows) if r[0] != "4000"] + [("4000", 0, "4000", True)] * 2
    assert result(linked_vectors(df)) == sorted(want)
    assert linked_vectors(df.limit(0)).count() == 0


def test_whole_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in v.select("vec_id", "embedding").collect()]
    assert result(linked_vectors(v)) == brute(rows)
