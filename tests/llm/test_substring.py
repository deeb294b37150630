"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tandem.llm.substring_dedup import drop_repeated_passages, repeated_windows


def brute(rows, k):
    first, out = {}, []
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            if d is not None:
                first[tuple(w[i:i + k])] = min(first.get(tuple(w[i:i + k]), d), d)
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 13)
    assert sum(r[2] for r in want) > 0
    assert result(drop_repeated_passages(docs)) == want


def test_branches_ragged_ends_and_runs(spark):
    rnd = random.Random(7)
    word = lambda: rnd.choice("abcdefghijklmnop") * 2
    passages = [[word() for _ in range(n)] for n in (13, 14, 30, 60)] + [["zz"] * 90, ["x", "y"] * 40]
    rows = []
    for i in range(80):
        t = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            t += [word() for _ in range(rnd.randint(0, 6))] + p[a:a + rnd.randint(1, 60)]
        rows.append((rnd.randrange(50) if i % 5 == 0 else 100 + i, "\n".join(t)))
    rows += [(500, None), (501, ""), (502, " \t"), (None, "zz " * 50), (503, "É " * 50), (504, "É " * 20), (504, "É " * 20), (504, "É " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as m", "2 as src", "3 as th").repartition(6)
    for k in (13, 3, 8):
        assert result(drop_repeated_passages(df, k=k)) == brute(rows, k), k
    assert drop_repeated_passages(df.limit(0)).count() == 0


def passages(spark):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") * 2
    shared = [[word() for _ in range(n)] for n in (13, 20, 45, 90)]
    texts = []
    for _ in range(60):
        p = rnd.choice(shared)
        a = rnd.randrange(len(p) - 12)
        texts.append(" ".join([word() for _ in range(rnd.randint(0, 9))] + p[a:a + rnd.randint(13, 70)] + [word() for _ in range(rnd.randint(0, 9))]))
    rows = [(rnd.randrange(45), t) for t in texts] + [(70, texts[0]), (70, texts[0])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text").repartition(5)


def test_sources_of_windows(spark, capsys):
    """Every window and its source against brute force; the lists of edges go through one exchange, by the
    minimizer, and into no written table."""
    rows, df = passages(spark)
    k, first, want = 13, {}, set()
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - k + 1):
            s = tuple(w[i:i + k])
            first[s] = min(first.get(s, d), d)
    for d, t in rows:
        w = t.split()
        want |= {(d, t, i) for i in range(len(w) - k + 1) if first[tuple(w[i:i + k])] < d}
    marks, found = repeated_windows(df, k), set()
    marks.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(m#") == 1
    assert not [x for x in plan.splitlines() if "FileScan" in x and "edges" in x]
    for r in marks.join(df.distinct(), ["doc_id", "th"]).collect():
        w = r.text.split()
        if r.n:
            found |= {(r.doc_id, r.text, r.start + i) for i in range(r.n)}
            assert r.src[0] < r.doc_id
            continue
        assert r.mask >> len(r.src) == 0
        for i, src in enumerate(r.src):
            low = first[tuple(w[r.start + i:r.start + i + k])]
            assert (src, bool(r.mask >> i & 1)) == (low, low < r.doc_id)
            if low < r.doc_id:
                found.add((r.doc_id, r.text, r.start + i))
    assert found == want and want
