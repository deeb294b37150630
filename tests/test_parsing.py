"""P1 / P2 against a plain-Python restatement of the reply-parsing rules."""

from pyspark.sql import functions as F

from tandem.functions.parsing import parse_choice, parse_correct


def reference_rule(s):
    # restatement: first piece before ' ', delete . " , ) ;, strip, else text before
    # the first newline, else 'E'
    s = str(s)
    w = s.split(" ")[0]
    for ch in '.",);':
        w = w.replace(ch, "")
    w = w.strip()
    if w not in ("A", "B", "C", "D"):
        w = w.split("\n")[0]
    return w if w in ("A", "B", "C", "D") else "E"


EDGE = ["A", "B.", '"C"', "D)", "A\nsince", "The answer is B", "b", None, " A", "(A", "A:", "A\r\nx",
        "A;", "A,", "\tB", "C\t", " D", "D　", "A B", ".A.", "AB", "", "\n", "B\n", "C. because",
        'A"', "E", "A\x1c", "\x85B"]


def test_parse_choice_matches_rule(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", parse_choice("s").alias("c")).collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == reference_rule(s), (repr(s), got[i])


def test_parse_correct(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (-1,)], "a int")
    got = [r.c for r in df.select(parse_correct(F.col("a")).alias("c")).collect()]
    assert got == ["A", "B", "C", "D", None, None]
