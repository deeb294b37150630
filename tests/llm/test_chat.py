"""Chat formatting against a plain prefix search."""

import random

from tandem.llm.chat import format_chats


def brute(rows):
    convs = {}
    for n, (c, t, r, x) in enumerate(dict.fromkeys(rows)):
        convs.setdefault((c, None) if c is not None else (None, (t, r, x)), []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    low_s = lambda v: (v is not None, v or "")
    seqs = {k: tuple((r, x) for _, r, x in sorted(v, key=lambda y: (low(y[0]), low_s(y[1]), low_s(y[2])))) for k, v in convs.items()}
    inner = {s[:i] for s in seqs.values() for i in range(1, len(s))}
    groups = {}
    for (c, _), s in seqs.items():
        if s not in inner:
            groups.setdefault(s, []).append(c)
    return sorted(((str(min((c for c in cs if c is not None), default=None)), len(s), len(cs),
                    "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s)) for s, cs in groups.items()))


def result(df):
    return sorted((str(r.conv_id), r.n_turns, r.n_copies, r.chat) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_snapshots_copies_and_ties(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        n = rnd.randint(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice("ab")) for t in range(n)]
    rows += [(100 + i, t, "user", "hello") for i in range(50) for t in range(1 + i % 2)]              # a hot conversation
    rows += rows[:20]                                                                                # repeated rows
    rows += [(200, 0, "b", "x"), (200, 0, "a", "y"), (200, None, "s", "z"), (201, 1, None, "x"), (202, 1, "", "x"), (203, 1, "u", None), (204, 1, "u", "")]
    rows += [(None, 0, "user", "hello"), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, None, None, None), (300, 0, "u", "x" * 100_000)]
    df = frame(spark, rows).selectExpr("*", "1 as pos", "2 as own", "3 as h1").repartition(5)
    assert result(format_chats(df)) == brute(rows)
    assert format_chats(df.limit(0)).count() == 0


def test_whole_table_with_snapshots(spark):
    log = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in log.collect()]
    snaps = [(c + 10_000, t, r, x) for c, t, r, x in rows if t < 2]
    assert result(format_chats(frame(spark, rows + snaps))) == brute(rows + snaps)


def test_plan_has_no_python(spark):
    df = format_chats(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct"))
