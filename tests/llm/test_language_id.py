"""Language ID: held-out accuracy, rejection and edge cases."""

from pyspark.sql import functions as F

from tandem.llm.language_id import classifier, identify, learn_dictionaries
from tandem.llm.queries import QUERIES


def test_held_out_accuracy_and_columns(spark):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_edges(spark):
    en, de = "the house of the man and the dog ", "das haus und der hund von dem mann "
    rows = [(i, (en if i % 2 else de) * 3 + str(i), "en" if i % 2 else "de") for i in range(20)]
    rows += [(100, en * 5000, "en"), (101, None, "de"), (102, "", None), (103, "12 !?", "en"), (104, "THE DOG AND THE MAN", None), (None, de, None), (None, de, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as head", "3 as lang_pred")
    dicts = learn_dictionaries(df, F.coalesce(F.col("doc_id") < 100, F.lit(False)), sample_texts=6)
    assert set(dicts) == {"en", "de"} and all(len(d) <= 112 * 1024 for d in dicts.values())
    got = identify(df, dicts, carry=["score", "lang_pred"])
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [by[k].lang_pred for k in (100, 104, None)] == ["en", "en", "de"]
    for k in (101, 102, 103):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[0].carried.score == 1 and by[0].carried.lang_pred == 3
    assert identify(df.limit(0), dicts).count() == 0
    none = learn_dictionaries(df.limit(0), F.lit(True))
    assert none == {} and {r.lang_pred for r in identify(df, none).collect()} == {"und"}


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "same text here", "xx") for i in range(300)] + [(i, f"another text {i}", "xx") for i in range(300, 310)]
    d = learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample_texts=200)
    assert d["xx"].count(b"same text here") == 1


def test_tie_and_single_language():
    predict = classifier({"a": b"abc abc", "b": b"abc abc"})
    assert predict("abc") == ("a", 0.0, True)
    assert classifier({"only": b"abc"})("x") == ("only", 1.0, False)


def test_copies_sorted_first_leave_the_sample_whole(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat('text number ', id, ' of the label') as text", "'xx' as lang")
    by_hash = [r.text for r in rows.orderBy(F.xxhash64("text")).collect()]
    copies = spark.range(3000).selectExpr("id as doc_id", f"'{by_hash[0]}' as text", "'xx' as lang")
    d = learn_dictionaries(rows.unionByName(copies), F.lit(True), sample_texts=100)
    assert d["xx"].decode().split("\n") == by_hash[:100]


def test_few_or_uneven_texts_fill_the_dictionary(spark):
    long = "".join(chr(97 + i * i % 26) + " " * (i % 5 == 0) for i in range(30_000))
    rows = [(i, f"{i} {long}", "rare") for i in range(10)] + [(i, f"{i} {long}" if i % 10 == 0 else f"short {i}", "uneven") for i in range(100)]
    rows += [(0, f"one {long}", "one"), (1, "İK only a little", "little")]
    d = learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), dict_bytes=20_000)
    assert all(20_000 - 100 <= len(d[k]) <= 20_000 for k in ("rare", "uneven", "one"))
    assert all(f"{i} {long}"[:1900].encode() in d["rare"] for i in range(10))
    assert d["uneven"].count(b"short") == 90 and d["little"] == "İK only a little".lower().encode()
