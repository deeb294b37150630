"""File scans and sinks of the evaluation runs.

Readers accept the reference's on-disk layouts; writers use Spark's own sinks, whose task and job commit
leave nothing of a failed attempt. Run files (reference layout, one CSV per (model, seed) run) are written by the text sink
to a hidden folder beside them and renamed when the job is committed. All of it works on any file system that Spark does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.session import ship_package, write_once


# ---- S1: reply tree <root>/<model>/responses_<start>_<end>_seed<seed>.csv -------------------

def _decoded(path: Column) -> Column:
    """A ``_metadata`` path without its percent-encoding (``+`` stays ``+``)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _tree_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all '.csv' files below ``root`` with the path as the scan gives it: what is known of a path is worked out once a
    file, not once a row."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
            .schema("reply string").csv(root)
            .select("reply", F.col("_metadata.file_path").alias("_raw")).withColumn("_id", F.monotonically_increasing_id()))


class ReplyTree:
    """A folder of run files, listed once, so that all scans number its rows alike.

    Files of every depth below ``root`` (not in it); model = name of the folder that holds the
    file, seed = the name up to its first '.', after its last 'seed' (a string); only '.csv'
    files, and none whose name contains ``exclude``. Files without a row are not listed."""

    def __init__(self, spark: SparkSession, root: str, exclude: str = "900"):
        self._rows = _tree_rows(spark, root)
        self._root, self._exclude = _qualified(spark, root), exclude
        self._files: DataFrame | None = None

    def files(self) -> DataFrame:
        """(model, seed, file, path, first_id, n_rows) of every file and its path in the scan, from one scan, written once."""
        if self._files is None:
            # written first: the planner would move what is asked of a path below the aggregate, to the rows
            facts = write_once(self._rows.groupBy("_raw").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))) \
                .withColumn("path", _decoded(F.col("_raw")))
            inside = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "/[^/]*$", "") != F.lit(self._root)
            parts = F.split("path", "/")
            file = F.element_at(parts, -1)
            seed = F.substring_index(F.substring_index(file, ".", 1), "seed", -1)
            self._files = write_once(facts.filter(inside & ~file.contains(self._exclude)).select(
                F.element_at(parts, -2).alias("model"), seed.alias("seed"), file.alias("file"), "path", "first_id", "n_rows", "_raw"))
        return self._files

    def read(self, files: DataFrame | None = None) -> DataFrame:
        """Every reply row of ``files`` (some rows of :meth:`files`; all by default), with the file's columns.

        A multi-line CSV file is never split, so its rows get consecutive ids inside one task; ``pos`` is
        the id minus the file's first id."""
        files = self.files() if files is None else files
        rest = [c for c in files.columns if c not in ("first_id", "model", "seed", "file", "path", "_raw")]
        return self._rows.join(files, "_raw").select(
            "model", "seed", "file", "path", (F.col("_id") - F.col("first_id")).alias("pos"), "reply", *rest)


def read_reply_tree(spark: SparkSession, root: str, exclude: str = "900") -> DataFrame:
    """S1 + W5: every reply row of every run file: (model, seed, file, path, pos, reply, n_rows); see :class:`ReplyTree`."""
    return ReplyTree(spark, root, exclude).read()


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, without a trailing '/'."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


TASK_ROWS = 1 << 20       # rows that one task sorts, on average
PIECE_BYTES = 1 << 20     # text that is handed on as one row, or one batch or line if that is less or more


def _join_lines(piece_bytes: int):
    """Sorted lines (run, seq, text) -> pieces of neighbouring lines of a run, under the first one's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, text = batch.column("run").to_numpy(), batch.column("text")
            nth = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // piece_bytes
            start = np.flatnonzero(np.append(True, (runs[1:] != runs[:-1]) | (nth[1:] != nth[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(runs)), pa.int32()), text)
            first = pa.array(start)
            yield pa.RecordBatch.from_arrays([batch.column("run").take(first), batch.column("seq").take(first), pc.binary_join(lists, "\n")],
                                             names=["run", "seq", "text"])

    return run


def write_reply_tree(replies: DataFrame, root: str, start: int = 0, end: int | None = None) -> DataFrame:
    """S5 (reference layout): one CSV ``<root>/<model>/responses_<start>_<end>_seed<seed>.csv`` per (model, seed)
    run with header ``0``, rows in (qid, rep) order, a NULL reply written as an empty field.

    Rows are sorted and formatted by many tasks; one task puts a run's pieces of text (``PIECE_BYTES``) in order and writes them (the
    layout has one file for a run). The text sink writes to a hidden folder below ``root``: attempts that fail or are killed leave no file there, and readers do not see it.
    After the job's commit its files replace those of the same names, one rename a run, and the folder is removed,
    also when the job fails. Returns (path, rows) per file."""
    spark = replies.sparkSession
    end = end if end is not None else 0
    run = ["model", "seed"]
    # one row per file that the driver will rename
    runs = [(i, r.model, r.seed, r.n) for i, r in enumerate(
        replies.where("model is not null and seed is not null").groupBy(*run).agg(F.count(F.lit(1)).alias("n")).collect())]
    types = {f.name: f.dataType.simpleString() for f in replies.schema.fields}
    if not runs:
        return spark.createDataFrame([], "path string, rows long")
    number = spark.createDataFrame([r[:3] for r in runs], f"run int, model {types['model']}, seed {types['seed']}")
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, sorters = min(len(runs), conf), max(conf, -(-sum(r[3] for r in runs) // TASK_ROWS))
    root = root.rstrip("/")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, root)
    done = []
    try:
        # A row per run is sent to the rows (a table made by the driver has no size for the planner, which would broadcast the
        # replies instead). Rows are sorted and turned into pieces of CSV text by many tasks; the one that writes a run orders pieces.
        csv = F.to_csv(F.struct(F.coalesce("reply", F.lit(""))), {"escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false",
                                                                 "ignoreTrailingWhiteSpace": "false"})
        plain = r"\A[A-Za-z0-9.()]++(?: ++[A-Za-z0-9.()]++)*+\z"      # CSV writes such text as it is
        line = F.when(F.col("reply").rlike(plain), F.col("reply")).otherwise(csv)
        order = ["run", "qid", "rep", "reply"]
        lines = replies.join(F.broadcast(number), run).select(*order).repartitionByRange(sorters, *order).sortWithinPartitions(*order) \
            .select("run", F.monotonically_increasing_id().alias("seq"), line.alias("text"))
        header = number.select("run", F.lit(-1).cast("long").alias("seq"), F.lit("0").alias("text"))
        # the partition column is a number, so the sink keeps the order of the sorted pieces
        lines.mapInArrow(_join_lines(PIECE_BYTES), "run int, seq long, text string").unionByName(header) \
            .repartitionById(parts, F.col("run") % parts).sortWithinPartitions("run", "seq") \
            .select("run", "text").write.partitionBy("run").text(staging)
        for i, model, seed, n in runs:
            written = [f.getPath() for f in fs.listStatus(path(f"{staging}/run={i}")) if f.getPath().getName().endswith(".txt")]
            if len(written) != 1:
                raise RuntimeError(f"run {model}, {seed}: {len(written)} files")
            name = f"{root}/{model}/responses_{start}_{end}_seed{seed}.csv"
            fs.mkdirs(path(name).getParent())
            fs.delete(path(name), False)
            if not fs.rename(written[0], path(name)):
                raise OSError(f"cannot rename a run file to {name}")
            done.append((name, n))
    finally:
        fs.delete(path(staging), True)
    return spark.createDataFrame(done, "path string, rows long")


def _file_system(spark: SparkSession, root: str):
    """The file system of ``root`` and the constructor of its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


# ---- S4: column-oriented JSON {"col": {"0": v, ...}} (pandas default layout) ----------------
#
# A file of this layout is one JSON object on one line. It is read as text cut at commas, so that
# Spark splits it over tasks. A piece that begins with a quoted number and a colon starts a cell, wherever the piece lies:
# a quote behind a comma either opens a string (then the comma is outside of strings) or closes one
# (then no digit can follow), and a quote inside a string is escaped. Likewise '":{"<number>":' starts a column.
# Other pieces continue the cell before them.

_CELL = r'^\s*"\d+"\s*:'
_COLUMN = r'"\s*:\s*\{\s*"\d+"\s*:'
_NAME = r'^\s*\{?\s*("(?:[^"\\]|\\.)*+")\s*:\s*\{\s*"\d+"\s*:'
_PREFIX = r'^[\s\S]*?"\s*:\s*\{\s*(?="\d+"\s*:)'
_PLAIN = r'^\s*"\d+"\s*:\s*"([^"\\]*+)"'             # a string without escapes, and a number or word: no parser needed
_WORD = r'^\s*"\d+"\s*:\s*([-+.\w]++)[\s}]*$'
# what of a cell's text needs no parser: number of the row, and a string without escapes or a number or word
_SIMPLE = (r'^[ \t\n\x0b\f\r]*"(?P<pos>[0-9]{1,18})"[ \t\n\x0b\f\r]*:[ \t\n\x0b\f\r]*'
           r'(?:"(?P<text>[^"\\]*)"|(?P<word>[-+.\w]+)[ \t\n\x0b\f\r}]*$)')
_CELLS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("part", pa.int8()), ("col", pa.string()),
                    ("named", pa.bool_()), ("text", pa.string()), ("range", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
_HEAD, _WHOLE, _TAIL = 0, 1, 2
_VALUES = pa.schema([("pos", pa.int64()), ("v", pa.string())])
TASK_CELLS = 1 << 20     # cells that one task sorts into rows, on average
RANGE = 1 << 16          # rows of a file that are put together at once


def _runs(*columns: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows that are equal in all columns (without nulls): (first, behind the last)."""
    size = len(columns[0])
    if not size:
        return []
    new = np.zeros(size, bool)
    new[0] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    lo = np.flatnonzero(new).tolist()
    return list(zip(lo, [*lo[1:], size]))


def _packed_cells(col: pa.Array, known: pa.Array, texts: pa.Array, rows: int) -> Iterator[dict]:
    """Whole cells -> fields of one row per run of a column and range of ``rows`` positions, its values packed; cells that need a
    parser come one by one, as their text."""
    found = pc.extract_regex(texts, _SIMPLE)
    simple = pc.is_valid(found)
    for i in pc.indices_nonzero(pc.invert(simple)).to_pylist():
        yield {"col": col[i].as_py(), "named": known[i].as_py(), "text": texts[i].as_py(), "size": 1}
    pos, text, word = (pc.filter(found.field(i), simple) for i in range(3))
    pos = pc.cast(pos, pa.int64())
    # a group that has no part in the match is empty, as the empty string is; the text tells them apart
    word = pc.if_else(pc.equal(word, "null"), pa.scalar(None, pa.string()), word)
    value = pc.if_else(pc.equal(pc.binary_length(pc.filter(found.field(2), simple)), 0), text, word)
    col, known = pc.filter(col, simple), pc.filter(known, simple)
    span = pa.array(pos.to_numpy() // rows)
    for a, b in _runs(pc.fill_null(col, ""), pc.is_null(col), known, span):
        batch = pa.RecordBatch.from_arrays([pos.slice(a, b - a), value.slice(a, b - a)], schema=_VALUES)
        yield {"col": col[a].as_py(), "named": known[a].as_py(), "range": span[a].as_py(), "size": b - a, "data": batch.serialize().to_pybytes()}


def _join_pieces(rows: int):
    """Pieces in file order -> cells. The pieces before the first start in a split belong to a cell of an earlier split
    (head), those from the last start on may go on in a later one (tail). Other cells come packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None           # (file, block) being read
        seq, col, named, open_, tail = 0, None, False, [], False

        def out(cells: list[dict], part: int) -> pa.RecordBatch:
            blank = {"file": at[0], "block": at[1], "part": part, "text": None, "range": None, "data": None}
            return pa.RecordBatch.from_pylist([{**blank, "seq": seq + i, **c} for i, c in enumerate(cells)], schema=_CELLS)

        def cut(part: int) -> pa.RecordBatch:
            return out([{"col": col, "named": named, "text": ",".join(open_), "size": 1}], part)

        for batch in batches:
            for lo, hi in _runs(batch.column("file"), batch.column("block")):
                here = batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py()
                if here != at:
                    if open_:
                        yield cut(_TAIL if tail else _HEAD)
                    at, seq, col, named, open_, tail = here, 0, None, False, [], False
                part = batch.slice(lo, hi - lo)
                start = np.flatnonzero(part.column("start").to_numpy(zero_copy_only=False))
                piece = part.column("piece")
                first = int(start[0]) if len(start) else part.num_rows
                open_ += piece.slice(0, first).to_pylist()
                if not len(start):
                    continue
                if open_:
                    yield cut(_WHOLE if tail else _HEAD)
                    seq += 1
                # the column of a cell: the last column started up to it, or the one the split was in
                begins = part.column("column").to_numpy(zero_copy_only=False)[start].astype(bool)
                last = np.maximum.accumulate(np.where(begins, np.arange(len(start)), -1))
                names = part.column("name").take(pa.array(start))
                names = pc.if_else(pa.array(last >= 0), names.take(pa.array(np.maximum(last, 0))), pa.scalar(col, pa.string()))
                known = pa.array((last >= 0) | named)
                if len(start) > 1:
                    if int(start[-1]) - first == len(start) - 1:        # every piece is a cell
                        texts = piece.slice(first, len(start) - 1)
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(start - first, pa.int32()), piece.slice(first, int(start[-1]) - first))
                        texts = pc.binary_join(lists, ",")
                    cells = list(_packed_cells(names.slice(0, len(start) - 1), known.slice(0, len(start) - 1), texts, rows))
                    yield out(cells, _WHOLE)
                    seq += len(cells)
                col, named = names[-1].as_py(), known[-1].as_py()
                open_, tail = piece.slice(int(start[-1])).to_pylist(), True
        if open_:
            yield cut(_TAIL if tail else _HEAD)

    return run


def _rows_of_range(columns: int, rows: int):
    """Values of one range of positions of a file, packed or one by one, -> a row per position; the first value that is no null wins."""

    def run(table: pa.Table) -> pa.Table:
        low = table["_range"][0].as_py() * rows
        parts: list[list[tuple[np.ndarray, pa.Array]]] = [[] for _ in range(columns)]
        alone = table.filter(pc.is_null(table["data"])).combine_chunks()
        for c in range(columns):
            one = alone.filter(pc.equal(alone["col"], c))
            if one.num_rows:
                parts[c].append((one["pos"].to_numpy(), one["v"].combine_chunks()))
        packed = table.filter(pc.is_valid(table["data"]))
        for c, data in zip(packed["col"].to_pylist(), packed["data"]):
            batch = pa.ipc.read_record_batch(data.as_buffer(), _VALUES)
            parts[c].append((batch.column(0).to_numpy(), batch.column(1)))
        seen, out = np.zeros(rows, bool), []
        for some in parts:
            at = np.full(rows, -1)
            if some:
                pos = np.concatenate([p for p, _ in some]) - low
                value = pa.concat_arrays([v.cast(pa.string()) for _, v in some])
                seen[pos] = True
                real = np.flatnonzero(value.is_valid().to_numpy(zero_copy_only=False))[::-1]
                at[pos[real]] = real
            out.append((at, value if some else pa.nulls(1, pa.string())))
        here = np.flatnonzero(seen)
        taken = [v.take(pa.array(at[here], mask=at[here] < 0)) for at, v in out]
        return pa.table([pa.repeat(table["_file"][0], len(here)), pa.array(here + low), *taken],
                        names=["_file", "pos", *[f"c{i}" for i in range(columns)]])

    return run


def read_column_json(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Rows of column-oriented JSON files; ``columns`` maps name -> Spark type.
    Output has ``file`` (decoded path), ``pos`` (the row key in its file) and the typed columns.

    A file is read by as many tasks as it has splits, in memory bounded by a batch of pieces and the longest cell; only
    cells of the asked columns leave the scan, packed by column and range of positions, so that a row of the shuffle
    holds thousands of values. A cell cut by a split is joined from its ends, which are few rows.
    Cells hold scalars, arrays or objects; an object inside a cell must not have numbers as keys. Names with commas
    cannot be asked for (columns of such names are passed over)."""
    if any("," in c for c in columns):
        raise ValueError("names of columns to read must not contain commas")
    ship_package(spark)
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = F.col("piece").rlike(_COLUMN)
    name = F.from_json(F.concat(F.lit("["), F.nullif(F.regexp_extract("piece", _NAME, 1), F.lit("")), F.lit("]")), "array<string>")[0]
    marked = raw.select("file", "block", (starts | F.col("piece").rlike(_CELL)).alias("start"), starts.alias("column"),
                        F.when(starts, name).alias("name"), F.when(starts, F.regexp_replace("piece", _PREFIX, "")).otherwise(F.col("piece")).alias("piece"))
    cells = marked.mapInArrow(_join_pieces(RANGE), "file string, block long, seq long, part tinyint, col string, named boolean, text string, "
                                                   "range long, size long, data binary")
    return _rows_of_cells(cells.withColumn("file", _decoded(F.col("file"))), columns)


def _rows_of_cells(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cells, and the ends of cells that splits cut, -> typed rows."""
    wanted = F.col("col").isin(list(columns)) | ~F.col("named") | (F.col("part") != _WHOLE)
    cells = write_once(cells.where(wanted))
    # one or two rows a split: the column that a split begins in, and the cells between splits
    order = Window.partitionBy("file").orderBy("block", "seq")
    ends = cells.where(F.col("part") != _WHOLE)
    in_column = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = cells.where(F.col("part") == _TAIL).select("file", "block", F.when(F.col("named"), F.struct("col")).alias("now"))
    begins = last.select("file", "block", F.last("now", ignorenulls=True).over(in_column)["col"].alias("inherited"))
    nth = F.sum((F.col("part") == _TAIL).cast("int")).over(order)
    joined = ends.withColumn("cell", nth).groupBy("file", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), ",").alias("text"),
        F.min(F.when(F.col("part") == _TAIL, F.struct("block", "named", "col"))).alias("t")) \
        .where("t is not null").select("file", F.col("t.block").alias("block"), F.col("t.named").alias("named"), F.col("t.col").alias("col"), "text")
    whole = cells.where(F.col("part") == _WHOLE).select("file", "block", "named", "col", "text", "range", "data")
    number = F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))]), F.col("col"))
    # ``begins`` has a row per split of the scan, a list that the driver already plans from: safe to broadcast
    both = whole.unionByName(joined, allowMissingColumns=True).join(F.broadcast(begins), ["file", "block"], "left") \
        .withColumn("col", F.when(F.col("named"), F.col("col")).otherwise(F.col("inherited"))).where(F.col("col").isin(list(columns)))
    # a cell is '"<pos>": value'; what follows the value (the end of the object) is not read
    entry = F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string, string>"))[0]
    word = F.nullif(F.regexp_extract("text", _WORD, 1), F.lit("null"))
    value = F.when(F.col("text").rlike(_PLAIN), F.regexp_extract("text", _PLAIN, 1)).when(F.col("text").rlike(_WORD), word).otherwise(entry["value"])
    alone = F.col("data").isNull()
    pos = F.when(alone, F.regexp_extract("text", r'^\s*"(\d+)"', 1).cast("bigint"))
    parsed = both.select("file", number.alias("col"), pos.alias("pos"), F.when(alone, value).alias("v"), "range", "data") \
        .withColumn("_range", F.coalesce("range", F.floor(F.col("pos") / F.lit(RANGE)).cast("bigint")))
    # Values of a row meet under a number for the file: a path in every value fills the sort of a task, while the compressed
    # shuffle that the planner sizes tasks by hides it. The number of tasks follows the number of cells.
    files = write_once(cells.select("file").distinct().withColumn("_file", F.monotonically_increasing_id()))
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(cells.agg(F.sum("size")).first()[0] or 0) // TASK_CELLS))
    keyed = parsed.join(files, "file").select("_file", "_range", "col", "pos", "v", "data").repartition(parts, "_file", "_range")
    rows = keyed.groupBy("_file", "_range").applyInArrow(_rows_of_range(len(columns), RANGE), "_file long, pos long, " + ", ".join(
        f"c{i} string" for i in range(len(columns))))
    return rows.join(files, "_file").select("file", "pos", *[F.col(f"c{i}").cast(t).alias(c) for i, (c, t) in enumerate(columns.items())])


def write_column_json(df: DataFrame, path: str, pos: str = "pos", rows_per_file: int = 10_000) -> None:
    """Column-oriented JSON writer: for tests and interchange with tools that read that layout.
    Each JSON object (one per line of a file part) holds at most ``rows_per_file`` consecutive
    positions, so no task gathers more than that into a row."""
    cols = [c for c in df.columns if c != pos]
    # one list of rows a block, not one of positions and values a column
    row = F.struct(F.col(pos).cast("string").alias("pos"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    block = F.floor(F.col(pos) / F.lit(rows_per_file)).alias("_block")
    rows = df.groupBy(block).agg(F.collect_list(row).alias("rows"))
    obj = rows.select(*[F.map_from_arrays(F.col("rows.pos"), F.col(f"rows.c{i}")).alias(c) for i, c in enumerate(cols)])
    obj.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


# ---- S5 / S6 / S7: Spark-native sinks ----------------------------------------------------

def write_runs(df: DataFrame, path: str, partition_by=("model", "seed"), fmt: str = "csv") -> None:
    """Keyed rows, partitioned by run keys. The partitions (runs) in ``df`` replace their
    earlier content; every other run in the folder stays."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def save_vocab(vocab: DataFrame, joint: DataFrame, sizes: DataFrame, common: DataFrame, root: str) -> None:
    """Vocabulary tables (token2id / id2token as one joint table, vocabulary info)."""
    vocab.write.mode("overwrite").parquet(f"{root}/model_vocab")
    joint.write.mode("overwrite").parquet(f"{root}/joint_vocab")
    sizes.write.mode("overwrite").parquet(f"{root}/vocab_length")
    common.write.mode("overwrite").parquet(f"{root}/common_tokens")


def load_vocab(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("model_vocab", "joint_vocab", "vocab_length", "common_tokens")}


# ---- S8: model list {"models": [...]} -------------------------------------------------------

def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """(model, mrank) from a JSON model list; the list position is the model rank."""
    j = spark.read.option("multiLine", True).json(path)
    return j.select(F.posexplode("models").alias("mrank", "model")).select("model", F.col("mrank").cast("int"))
