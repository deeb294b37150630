"""Reply-tree scan quirks: non-csv and '900' files skipped, positions, quoting, length guard."""

import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tandem.operators.scoring import head_questions, length_guard, score, tree_replies
from tandem.sources.files import read_column_json, read_model_list, read_reply_tree, write_reply_tree, write_runs


def write(path, replies):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["0"])
        for r in replies:
            w.writerow([r])


def test_reply_tree(spark):
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    write(f"{root}/mA/responses_0_3_seed11.csv", ["A", 'say "B", then\nC', ""])
    write(f"{root}/mA/responses_0_3_seed9001.csv", ["A", "A", "A"])      # contains 900: skipped
    write(f"{root}/mB/responses_0_3_seed12.csv", ["D", "C"])            # a row short
    with open(f"{root}/mB/notes.txt", "w") as f:
        f.write("not a run file\n")
    df = read_reply_tree(spark, root)
    rows = sorted((r.model, r.seed, r.pos, r.reply) for r in df.collect())
    assert rows == [("mA", "11", 0, "A"), ("mA", "11", 1, 'say "B", then\nC'), ("mA", "11", 2, None),
                    ("mB", "12", 0, "D"), ("mB", "12", 1, "C")]
    q = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    g = {(r.model, r.seed): r.accepted for r in length_guard(df, q, 1).collect()}
    assert g == {("mA", "11"): True, ("mB", "12"): False}


def test_model_list(spark):
    d = tempfile.mkdtemp(prefix="tandem-models-")
    with open(f"{d}/models.json", "w") as f:
        f.write('{\n  "models" : [\n "m1", "m2",\n "m3", "m4"]\n}')
    got = sorted((r.mrank, r.model) for r in read_model_list(spark, f"{d}/models.json").collect())
    assert got == [(0, "m1"), (1, "m2"), (2, "m3"), (3, "m4")]


def test_nested_folders_text_seeds_and_odd_names(spark):
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    write(f"{root}/org/my model+1/responses_0_2_seedabc.x.csv", ["A", "B"])
    write(f"{root}/org/my model+1/deeper/mB/responses_0_2_seed7.csv", ["C", "D"])
    write(f"{root}/responses_0_2_seed8.csv", ["A", "A"])                  # not in a model folder
    got = sorted((r.model, r.seed, r.pos, r.reply) for r in read_reply_tree(spark, root + "/").collect())
    assert got == [("mB", "7", 0, "C"), ("mB", "7", 1, "D"), ("my model+1", "abc", 0, "A"), ("my model+1", "abc", 1, "B")]


def test_files_of_a_run_are_guarded_and_appended_by_file(spark):
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    write(f"{root}/m/responses_0_2_seed1.csv", ["A", "B", "C", "D"])       # 2 questions x 2 repeats
    write(f"{root}/m/responses_1_2_seed1.csv", ["B", "B", "B", "B"])       # appended
    write(f"{root}/n/responses_0_1_seed2.csv", ["A", "B"])                 # two halves are not a file
    write(f"{root}/n/responses_1_2_seed2.csv", ["C", "D"])
    q = spark.createDataFrame([(5, "s", 0), (9, "s", 1)], "qid long, subject string, answer int")
    rows = tree_replies(read_reply_tree(spark, root), q, 2)
    assert sorted(map(tuple, rows.collect())) == [("m", "1", 5, 0, "A"), ("m", "1", 5, 1, "B"), ("m", "1", 5, 2, "B"), ("m", "1", 5, 3, "B"),
                                                  ("m", "1", 9, 0, "C"), ("m", "1", 9, 1, "D"), ("m", "1", 9, 2, "B"), ("m", "1", 9, 3, "B")]
    ok = sorted((r.qid, r.rep, r.ok) for r in score(rows, q, 1, 2, guard=False).collect())
    assert ok == [(5, 0, True), (5, 1, False), (5, 2, False), (5, 3, False), (9, 0, False), (9, 1, False), (9, 2, True), (9, 3, True)]


def test_head_questions_go_by_position(spark):
    q = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "qid long")
    assert sorted(r.qid for r in head_questions(q, 3).collect()) == [1, 2, 3]


def test_column_json_keeps_rows_of_all_files(spark):
    d = tempfile.mkdtemp(prefix="tandem-json-")
    for i in (0, 1):
        with open(f"{d}/{i}.json", "w") as f:
            f.write('{"a": {"0": "x%d", "1": null}, "n": {"0": 1, "1": 2}}' % i)
    got = sorted(((r.file[-6:], r.pos, r.a, r.n) for r in read_column_json(spark, d, {"a": "string", "n": "int"}).collect()), key=str)
    assert got == [("0.json", 0, "x0", 1), ("0.json", 1, None, 2), ("1.json", 0, "x1", 1), ("1.json", 1, None, 2)]


def test_a_rewritten_run_leaves_the_others(spark):
    d = tempfile.mkdtemp(prefix="tandem-runs-") + "/out"
    df = lambda rows: spark.createDataFrame(rows, "model string, seed string, reply string")
    write_runs(df([("a", "1", "x"), ("a", "2", "y")]), d)
    write_runs(df([("b", "1", "z")]), d)
    write_runs(df([("a", "2", "new")]), d)
    back = spark.read.option("header", True).schema("reply string, model string, seed string").csv(d)
    assert sorted((r.model, r.seed, r.reply) for r in back.collect()) == [("a", "1", "x"), ("a", "2", "new"), ("b", "1", "z")]


NASTY = ['', 'plain', 'a,b', ',', 'ends,', 'ends\\', 'q"uote', '","5":"x', ',"7":', '\\",\\"8":{"0":1}', '":{"0":', 'line\nbreak, "9": z', '{"a":{"0":"1"}}',
         '}},', 'é\u2028\U0001F600,x', '\x00\t', ' "12" : ', '/slash/']


def column_objects(seed):
    """Objects of three asked columns and others around them, with strings that look like the layout."""
    rnd = random.Random(seed)
    n = rnd.choice([0, 1, 7, 120])
    text = lambda: rnd.choice([None, *NASTY, "".join(rnd.choice(NASTY) for _ in range(6)), "w, " * rnd.choice([1, 400])])
    cols = {"a b": text, "empty, named": text, 'q"c': text, "n": lambda: rnd.choice([None, 0, -5, 12345678901]),
            "list": lambda: [text() or "", rnd.randint(0, 9)], "obj": lambda: {"x": text(), "y": [1, {"z": 2}]}, "0": text}
    names = list(cols)
    rnd.shuffle(names)
    return {c: {str(i): cols[c]() for i in range(n)} if rnd.random() < 0.9 or c in ("a b", "n") else {} for c in names}, n


@pytest.mark.parametrize("split", [None, 37, 400])
def test_column_json_in_splits(spark, split):
    """Whatever the split size, also far below a cell, the rows are those of a whole parse."""
    d = tempfile.mkdtemp(prefix="tandem-json-")
    want = {}
    for i in range(6 if split == 37 else 12):
        obj, n = column_objects(i)
        if split == 37 and n > 10:
            obj, n = {c: {k: v for k, v in x.items() if int(k) < 3} for c, x in obj.items()}, 3
        style = [{"separators": (",", ":")}, {}, {"ensure_ascii": False, "separators": (",", ":")}, {"indent": 1}][i % 4]
        with open(f"{d}/f{i}.json", "w") as f:
            json.dump(obj, f, **style)
        for k in range(n):
            want[f"f{i}.json", k] = tuple(obj[c].get(str(k)) for c in ("a b", 'q"c', "n", "list", "0"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        rows = read_column_json(spark, d, {"a b": "string", 'q"c': "string", "n": "bigint", "list": "string", "0": "string"}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.file.split("/")[-1], r.pos): (r["a b"], r['q"c'], r.n, json.loads(r["list"]) if r["list"] else None, r["0"]) for r in rows}
    assert len(rows) == len(got) and got == want


def test_column_names_with_commas_are_refused(spark):
    with pytest.raises(ValueError):
        read_column_json(spark, "/nowhere", {"a,b": "string"})


def run_rows(spark):
    texts = ["A", None, "", ' lead "q", and\nline', "trail ", "é", "a\r\nb", '""', ",", "\\", '\\"', "#x"]
    rows = [(m, s, q, r, texts[(q * 3 + r + len(m)) % len(texts)]) for m in ("mA", "my model+1") for s in ("11", "007") for q in range(40) for r in range(3)]
    return spark.createDataFrame(rows, "model string, seed string, qid long, rep int, reply string").repartition(7), rows


def test_run_files_round_trip(spark):
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    df, rows = run_rows(spark)
    files = {(r.path, r.rows) for r in write_reply_tree(df, root, 0, 40).collect()}
    assert files == {(f"{root}/{m}/responses_0_40_seed{s}.csv", 120) for m in ("mA", "my model+1") for s in ("11", "007")}
    want = {}
    for m, s, q, r, t in sorted(rows, key=lambda x: x[:4]):
        want.setdefault((m, s), []).append(t)
    for (m, s), texts in want.items():
        with open(f"{root}/{m}/responses_0_40_seed{s}.csv", newline="") as f:
            assert [x[0] for x in csv.reader(f)] == ["0", *[t or "" for t in texts]]
    got = {}
    for r in read_reply_tree(spark, root).orderBy("model", "seed", "pos").collect():
        got.setdefault((r.model, r.seed), []).append(r.reply)
    assert {k: [t or "" for t in v] for k, v in got.items()} == {k: [t or "" for t in v] for k, v in want.items()}
    again = df.where("model = 'mA' and seed = '11'").withColumn("reply", F.lit("new"))
    write_reply_tree(again, root, 0, 40)                      # replaces its file, leaves the others
    back = {(r.model, r.seed): r.n for r in read_reply_tree(spark, root).where("reply = 'new'").groupBy("model", "seed").agg(F.count("*").alias("n")).collect()}
    assert back == {("mA", "11"): 120} and read_reply_tree(spark, root).count() == 480


def test_a_failed_run_file_job_leaves_nothing(spark):
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    df, _ = run_rows(spark)
    write_reply_tree(df.where("model = 'mA'"), root)
    before = sorted((d, tuple(f)) for d, _, f in os.walk(root))
    bad = df.withColumn("reply", F.when(F.col("qid") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_reply_tree(bad, root)
    assert sorted((d, tuple(f)) for d, _, f in os.walk(root)) == before
    assert write_reply_tree(df.where("false"), root).count() == 0


def test_run_files_on_another_file_system(spark):
    """Any file system that Spark opens, not only local paths."""
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./out", f"file://{root}")
    df, rows = run_rows(spark)
    write_reply_tree(df, "viewfs://runs/out/tree")
    got = read_reply_tree(spark, "viewfs://runs/out/tree")
    assert got.count() == len(rows) and {r.model for r in got.select("model").distinct().collect()} == {"mA", "my model+1"}
    assert sorted(os.listdir(f"{root}/tree")) == ["mA", "my model+1"]


def test_tree_accuracy_scans_the_folder_twice(spark):
    """One scan for the file table (starts, row counts), one for the accepted files' rows."""
    from tandem.operators.scoring import accepted_files
    from tandem.sources.files import ReplyTree
    root = tempfile.mkdtemp(prefix="tandem-tree-")
    write(f"{root}/m/responses_0_2_seed1.csv", ["A", "B", "C", "D"])
    write(f"{root}/m/responses_1_2_seed1.csv", ["B", "B", "B", "B"])
    write(f"{root}/n/responses_0_1_seed2.csv", ["A", "B"])
    q = spark.createDataFrame([(5, "s", 0), (9, "s", 1)], "qid long, subject string, answer int")
    tree = ReplyTree(spark, root)
    write(f"{root}/a/responses_0_2_seed1.csv", ["A", "B", "C", "D"])           # after the listing: not part of it
    rows = tree_replies(tree.read(accepted_files(tree.files(), q, 2)), q, 2)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    slow = tree_replies(read_reply_tree(spark, root).where("model <> 'a'"), q, 2)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, slow.collect())) and rows.count() == 8
    guard = {(r.path[-24:], r.n_rows, r.accepted) for r in length_guard(tree.files(), q, 2, ["path"]).collect()}
    assert guard == {("responses_0_2_seed1.csv"[-24:].rjust(24, "/"), 4, True), ("/responses_1_2_seed1.csv", 4, True), ("/responses_0_1_seed2.csv", 2, False)}


def test_lowest_runs_read_the_replies_once(spark):
    from tandem.operators.scoring import first_seed, lowest_runs
    rows = [("m", s, q, r, "ABCD"[(q + r + s) % 4]) for s in (3, 7, 9) for q in (1, 2, 4) for r in (0, 1) if (s, q, r) != (3, 4, 1)]
    rows += [("k", 7, q, r, None) for q in (1, 2, 4) for r in (0, 1)]
    q = spark.createDataFrame([(1, "s", 0), (2, "t", 1), (4, "t", 9)], "qid long, subject string, answer int")
    df = spark.createDataFrame(rows, "model string, seed long, qid long, rep int, reply string")
    got = lowest_runs(df, q, 7, 2)
    cols = ["noise", "model", "seed", "subject", "qid", "rep", "ok"]
    want = first_seed(score(df, q, 7, 2)).select(cols)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r.noise, r.model, r.seed) for r in got.collect()} == {("Coupled", "m", 7), ("Coupled", "k", 7), ("Independent", "m", 9)}
    assert "reply#" not in got._jdf.queryExecution().executedPlan().toString()        # only the written scores


def test_writing_runs_broadcasts_the_runs_not_the_replies(spark, tmp_path, monkeypatch):
    """A small estimate of the replies (an exploded table) must not send them all through the driver."""
    plans = []
    frame = type(spark.range(1))
    plain = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a))
    r = spark.range(20).select(F.concat(F.lit("m"), F.col("id") % 2).alias("model"), (F.col("id") % 2).alias("seed"), F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("rep"),
                               F.lit("A").alias("reply"))
    assert [x.rows for x in write_reply_tree(r, str(tmp_path / "t")).collect()] == [100, 100]
    joined = [p for p in plans if "BroadcastHashJoin" in p]
    assert joined and all("BuildRight" in p for p in joined)


def test_values_of_a_row_meet_without_their_path(spark, tmp_path, monkeypatch):
    """The shuffle of the values carries a file number, over as many tasks as the cells need."""
    from tandem.sources import files as fl
    monkeypatch.setattr(fl, "TASK_CELLS", 7)
    for name, n in (("one", 30), ("two", 12)):
        (tmp_path / name).write_text(json.dumps({"a": {str(i): i for i in range(n)}, "b": {str(i): f"{name},{i}" for i in range(n)}}))
    df = read_column_json(spark, [str(tmp_path / n) for n in ("one", "two")], {"a": "bigint", "b": "string"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(moved) == 1 and "file#" not in moved[0].replace("_file#", "") and moved[0].rstrip().endswith("12")
    got = sorted((r.file.rsplit("/", 1)[1], r.pos, r.a, r.b) for r in df.collect())
    assert got == sorted((name, i, i, f"{name},{i}") for name, n in (("one", 30), ("two", 12)) for i in range(n))


@pytest.mark.parametrize("piece_bytes", [1, 30, 1 << 20])
def test_one_task_orders_pieces_of_a_run_not_its_rows(spark, tmp_path, monkeypatch, piece_bytes):
    """Many tasks sort and format the rows; the text equals the CSV writer's, whatever the size of the pieces."""
    from tandem.sources import files as fl
    monkeypatch.setattr(fl, "PIECE_BYTES", piece_bytes)
    frame, moved = type(spark.range(1)), []
    plain = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, *a: moved.append(df.count()) or plain(df, *a))
    values = ["A", None, "", 'say "B"', "two\nlines", "a,b", "  blank  ", "\u00e9\r\n", "\\"]
    rows = [(m, s, q, rep, values[(q * 3 + rep) % 9]) for m, s in (("x", "1"), ("x", "2"), ("y", "1")) for q in range(40) for rep in range(3)]
    random.Random(1).shuffle(rows)
    write_reply_tree(spark.createDataFrame(rows, "model string, seed string, qid long, rep int, reply string").repartition(5), str(tmp_path / "t"))
    pieces = moved[0] - 3                 # a header a run
    assert pieces <= 3 + 8 if piece_bytes > 1000 else 3 <= pieces <= 360
    want = spark.createDataFrame([(q, rep, values[(q * 3 + rep) % 9] or "") for q in range(40) for rep in range(3)], "qid long, rep int, `0` string")
    want.coalesce(1).sortWithinPartitions("qid", "rep").select("0").write.option("header", True).option("escape", '"').option("emptyValue", '""') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "one"))
    text = next((tmp_path / "one").glob("*.csv")).read_bytes()
    for m, s in (("x", "1"), ("x", "2"), ("y", "1")):
        assert (tmp_path / "t" / m / f"responses_0_0_seed{s}.csv").read_bytes() == text


def test_cells_leave_the_scan_packed(spark, tmp_path):
    """A row of the shuffle holds the values of a column and a range of positions; only cells that need a parser come one by one."""
    from tandem.sources import files as fl
    n = 700
    cells = {"a": {str(i): f"x{i}" for i in range(n)}, "b": {str(i): None if i % 7 == 0 else i for i in range(n)}}
    cells["a"]["3"] = 'q"uote'
    (tmp_path / "one").write_text(json.dumps(cells))
    moved, kept = [], fl.write_once
    fl.write_once = lambda df: moved.append(kept(df)) or moved[-1]
    try:
        got = read_column_json(spark, str(tmp_path / "one"), {"a": "string", "b": "bigint"}).collect()
    finally:
        fl.write_once = kept
    assert sorted((r.pos, r.a, r.b) for r in got) == [(i, cells["a"][str(i)], cells["b"][str(i)]) for i in range(n)]
    assert moved[0].count() < 8 and moved[0].agg(F.sum("size")).first()[0] == 2 * n


@pytest.mark.parametrize("rows", [1, 10, 1 << 16])
def test_values_by_range_of_positions(spark, tmp_path, monkeypatch, rows):
    """Any width of a range; columns of different positions; a key that comes twice keeps a value that is no null."""
    from tandem.sources import files as fl
    monkeypatch.setattr(fl, "RANGE", rows)
    (tmp_path / "one").write_text('{"a": {"5": "", "70000": "null", "9": null, "9": "later"}, "b": {"0": 1, "70000": null, "31": -25, "33": null}, "c": {}}')
    got = sorted((r.pos, r.a, r.b, r.c) for r in read_column_json(spark, str(tmp_path / "one"), {"a": "string", "b": "string", "c": "int"}).collect())
    assert got == [(0, None, "1", None), (5, "", None, None), (9, "later", None, None), (31, None, "-25", None), (33, None, None, None), (70000, "null", None, None)]


def test_a_path_is_worked_out_once_a_file(spark):
    """No decoding, splitting or comparing of paths in the scans of the rows."""
    from tandem.sources import files as fl
    root = tempfile.mkdtemp(prefix="tandem-tree-") + "/a b%2B+c"
    write(f"{root}/m x/responses_0_2_seed1.csv", ["A", "B", "C", "D"])
    write(f"{root}/m x/responses_0_2_seed9001.csv", ["A"])
    write(f"{root}/responses_0_2_seed1.csv", ["A"])                # not in a model's folder
    plans, kept = [], fl.write_once
    fl.write_once = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df)
    try:
        tree = fl.ReplyTree(spark, root)
        files = [(r.model, r.seed, r.file, r.n_rows) for r in tree.files().collect()]
        rows = tree.read()
    finally:
        fl.write_once = kept
    assert files == [("m x", "1", "responses_0_2_seed1.csv", 4)]
    scans = [p for p in [*plans, rows._jdf.queryExecution().optimizedPlan().toString()] if " csv" in p]
    assert len(scans) == 2 and not any(w in p for p in scans for w in ("url_decode", "regexp_replace", "split(", "element_at"))
    assert sorted((r.pos, r.reply, r.model) for r in rows.collect()) == [(i, c, "m x") for i, c in enumerate("ABCD")]


def test_column_json_writer_keeps_nulls_and_names(spark, tmp_path):
    from tandem.sources.files import write_column_json
    rows = [(i, None if i % 3 == 0 else f'v"{i}\n', i * 2) for i in range(25)]
    write_column_json(spark.createDataFrame(rows, "pos long, `a b` string, rows int"), f"{tmp_path}/out", rows_per_file=10)
    got = read_column_json(spark, f"{tmp_path}/out", {"a b": "string", "rows": "int"}).collect()
    assert sorted((r.pos, r["a b"], r.rows) for r in got) == rows
    texts = [json.loads(line) for r in spark.read.text(f"{tmp_path}/out").collect() for line in r]
    assert sorted(int(k) for t in texts for k in t["rows"]) == list(range(25)) and len(texts) == 3
