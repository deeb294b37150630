"""The corpus pipeline stage by stage on one fixture, and the queries' registration."""

import zlib

import numpy as np
import pytest
from test_lines_op import brute as lines_brute
from test_near_dup import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from tandem.llm.packing import default_tokenizer
from tandem.llm.queries import ORACLE, QUERIES
from tandem.plans.check import _TYPES, duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / f"{i}{name}")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_languages(stages):
    docs, known = stages[:2]
    for s in stages[:-1]:
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    kept = {r.doc_id: tuple(r) for r in known.collect()}
    assert all(kept[r.doc_id] == tuple(r) for r in docs.collect() if r.doc_id in kept) and len(kept) >= 0.98 * docs.count()


def test_lines(stages):
    known, cut = stages[1:3]
    want = {d: t for d, _, _, _, t in lines_brute([(r.doc_id, r.text) for r in known.collect()], 10)}
    rows = cut.collect()
    assert {str(r.doc_id): r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates(stages):
    cut, single = stages[2:4]
    want = near_brute([(r.doc_id, r.text) for r in cut.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, (_, _, kept) in want.items() if kept}


def test_contaminated_go(stages, spark):
    from test_decontaminate import brute
    single, clean = stages[3:5]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    gone = {r[0] for r in brute(rows, items)}
    assert gone and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - gone


def test_packed(stages, spark):
    clean, packed = stages[4:]
    tok = Tokenizer.from_file(default_tokenizer())
    want = {}
    for r in clean.collect():
        want[r.doc_id] = tok.encode(r.text, add_special_tokens=False).ids + [0]
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the dog and the man of the house", "en", None, 4), (None, "some words without an id", "en", "s", 1),
            (3, "the dog and the man of the house", "en", None, 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n >= (2 if docs.head(1) else 0)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Copies go, also with the same or no id; a text goes only for itself, never for another row of its id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    copy, own = "one two three four five six seven", "quite another text of its own words here"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(5, copy), (7, copy), (7, own), (8, own + " x"), (9, "lone words that are in no other row"), (9, "lone words that are in no other row"),
            (9, None), (None, copy), (None, "a text without any id at all"), (None, "a text without any id at all"), (3, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema).repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(5, copy), (7, own), (9, "lone words that are in no other row"), (9, None), (None, "a text without any id at all"), (3, ""), (4, "")], key=str)
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in [(1, item), (1, own), (None, item), (None, own), (2, copy)]], schema)
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, own), (None, own), (2, copy)], key=str)


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert all(f.__doc__ for f in QUERIES.values()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(spark, key):
    df = QUERIES[key](spark, SF)
    rel = duck(SF).sql(ORACLE[key])
    names = list(rel.columns)
    assert {f.name: _TYPES[f.dataType.simpleString()] for f in df.schema.fields} == dict(zip(names, map(str, rel.types), strict=True))
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(names, rel.fetchall())
