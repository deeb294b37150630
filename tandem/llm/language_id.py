"""Language ID by compression: the language whose zstandard raw-content dictionary shrinks a text most.

A dictionary per language is the concatenated text of a bounded sample of labelled documents.
Every whole text is lower-cased, cut into pieces of ``piece_bytes`` and compressed with each
dictionary; the language with the smallest total size wins. A narrow margin rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.arrow import pick
from tandem.session import ship_package

LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def learn_dictionaries(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
                       sample_texts: int = 256, dict_bytes: int = 112 * 1024) -> dict[str, bytes]:
    """One raw-content dictionary per non-null label among the rows where ``train`` holds.

    The bounded sample: per label, the ``sample_texts`` distinct texts with the smallest hash, or all
    if there are fewer, and the concatenation of their lower-cased heads. The heads share
    ``dict_bytes`` evenly, and what a short text leaves goes to the longer ones, so a label with
    enough text fills its dictionary whatever the number of its texts. Copies are combined before
    the sample is cut, first within each task; the cut is a window group limit, so of each label a
    task sends at most ``sample_texts`` hashes. A second pass fetches the heads, so the driver
    receives about ``dict_bytes`` characters a label. Null texts and texts without a letter are not
    sampled. No labelled text: an empty dictionary set.
    """
    rows = (pick(docs.where(train), text=text, lang=lang)
            .where("lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("text")))
    size = F.octet_length(F.lower(F.substring("text", 1, dict_bytes)))
    few = (rows.groupBy("lang", "h").agg(F.min(size).alias("n"))
           .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_texts))
    sizes: dict[str, dict[int, int]] = {}
    for r in few.collect():
        sizes.setdefault(r.lang, {})[r.h] = r.n
    if not sizes:
        return {}
    share = {k: _even_share(list(v.values()), dict_bytes - len(v) + 1) for k, v in sizes.items()}
    # at most sample_texts rows a label
    chosen = docs.sparkSession.createDataFrame([(k, h, share[k]) for k, v in sizes.items() for h in v],
                                               f"lang {few.schema['lang'].dataType.simpleString()}, h long, share int")
    heads = (rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h")
             .agg(F.min(F.lower(F.expr("substring(text, 1, share)"))).alias("head")))
    out: dict[str, list[bytes]] = {}
    for r in sorted(heads.collect(), key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).append(r.head.encode()[:share[r.lang]])
    return {k: b"\n".join(v)[-dict_bytes:] for k, v in out.items()}


def _even_share(sizes: list[int], total: int) -> int:
    """Bytes a text may give so that texts of these ``sizes`` give ``total`` together, or all they have; 64 at least."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return max(64, left // (len(sizes) - i))
        left -= n
    return max(64, *sizes)


def classifier(dicts: dict[str, bytes], level: int = 6, piece_bytes: int = 2000, min_margin: float = 0.002):
    """A function text -> (language, score, rejected); see :func:`identify`."""
    import zstandard as zstd
    tools = []
    for name in sorted(dicts):
        d = zstd.ZstdCompressionDict(dicts[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        tools.append((name, zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                write_dict_id=False, write_checksum=False)))

    def predict(text: str | None):
        if not text or not tools or not LETTER.search(text):
            return "und", 0.0, True
        raw = text.lower().encode()
        pieces = [raw[i:i + piece_bytes] for i in range(0, len(raw), piece_bytes)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in tools)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        best, second = sizes[0][0], sizes[1][0]
        score = min(1.0, max(0.0, (second - best) / second))
        return sizes[0][1], score, score < min_margin

    return predict


def identify(docs: DataFrame, dicts: dict[str, bytes], id: str = "doc_id", text: str = "text",  # noqa: A002
             level: int = 6, piece_bytes: int = 2000, min_margin: float = 0.002,
             carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, in one pass and without a shuffle.

    The columns of ``docs`` named in ``carry`` follow, unchanged, as fields of the struct ``carried``.

    ``score`` is the margin ``(second - best) / second`` of the compressed sizes, 1 if only one
    language was learned; ``rejected`` is ``score < min_margin``. A text that is null, empty or
    has no letter (or any text when nothing was learned) is ``und`` with score 0, rejected. Equal
    sizes go to the first name. Repeated rows give repeated results; an empty table none.
    """
    types = [pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = classifier(dicts, level, piece_bytes, min_margin)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [predict(x.as_py()) for x in part.column(1)]
                cols = list(zip(*got, strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *part.columns[2:]],
                                      names=["doc_id", "lang_pred", "score", "rejected", *part.schema.names[2:]])

    base = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"),
                       *([F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []))
    ship_package(docs.sparkSession)
    more = f", carried {base.schema['carried'].dataType.simpleString()}" if carry else ""
    return base.mapInArrow(run, SCHEMA + more)
