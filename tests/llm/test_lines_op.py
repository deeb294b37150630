"""Line dedup against brute force."""

import hashlib

import numpy as np

from tandem.llm.bloom import contains, positions
from tandem.llm.line_dedup import drop_repeated_lines

WS = " \t\n\r\x0b\x0c"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WS).translate(FOLD)


def brute(rows, min_docs, min_chars=1, keep_first=False):
    holders, first = {}, {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            holders.setdefault(key(line), set()).add(d)
            k = (d is not None, d, i)
            first[key(line)] = min(first.get(key(line), k), k, key=lambda x: (x[0], x[1] or 0, x[2]))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs
                or keep_first and first[key(x)] == (d is not None, d, i)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in df.collect())


ROWS = [(i, f"Header\nunique {i}\n  header \n\n\nbody É {i % 3}") for i in range(12)] + \
    [(20, None), (21, ""), (22, "\n"), (23, "header"), (23, "header\n\theader"), (None, "HEADER\nx"), (None, "HEADER\nx"), (24, "é\nÉ")]


def test_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as k1", "2 as drops", "3 as kept").repartition(5)
    for args in ({"min_docs": 10}, {"min_docs": 3}, {"min_docs": 2, "min_chars": 3}, {"min_docs": 2, "keep_first": True}, {"min_docs": 2, "max_bits": 64}):
        want = brute(ROWS, **{k: v for k, v in args.items() if k != "max_bits"})
        assert result(drop_repeated_lines(df, **args)) == want, args
    carried = drop_repeated_lines(df, min_docs=3, carry=["kept", "drops"]).select("carried.*").distinct().collect()
    assert [tuple(r) for r in carried] == [(3, 2)]
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(drop_repeated_lines(docs, min_docs=4)) == brute(rows, 4)


def test_filter_has_no_false_negative():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 62, (500, 2), dtype=np.uint64)
    bits = np.zeros(1 << 16, bool)
    bits[positions(keys, 1 << 16, 4).ravel()] = True
    packed = np.packbits(bits)
    assert contains(packed, positions(keys, 1 << 16, 4)).all()
    assert contains(packed, positions(rng.integers(0, 1 << 62, (5000, 2), dtype=np.uint64), 1 << 16, 4)).mean() < 0.01
