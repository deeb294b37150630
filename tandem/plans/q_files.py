"""Source / sink queries: write derived data with the library's sinks, read it back with
its scans. Files go to a fresh folder under the session's shared checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tandem.functions.parsing import parse_choice_sql
from tandem.operators import runs as ru
from tandem.operators import scoring as sc
from tandem.operators import vocab as vo
from tandem.operators.indexing import ordinal
from tandem.operators.pairwise import NOISES
from tandem.plans.oracle import F1, F2, F3, F4, F6, sql
from tandem.plans.registry import query, rounded
from tandem.session import checkpoint_dir, write_once
from tandem.sources import files as fl
from tandem.sources import fixtures as fx


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, made by its own file system."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tandem-files/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


@query("csv_tree", sql("""select model, cast(seed as varchar) seed, 'responses_0_0_seed' || seed || '.csv' file,
  row_number() over (partition by model, seed order by qid, rep) - 1 pos, reply from f2""", ("f2", F2)))
def csv_tree(spark, sf):
    """S1 + S5 + W5: run files in the reference layout (plus an excluded '900' file),
    scanned back with model, seed and row position from the path."""
    root = scratch(spark, "replies")
    r = fx.replies(spark, sf)
    fl.write_reply_tree(r, root).count()
    extra = r.filter((F.col("model") == "m8b") & (F.col("seed") == fx.COUPLED_SEED)).withColumn("seed", F.lit(9001))
    fl.write_reply_tree(extra, root).count()        # name contains '900': must be skipped
    return fl.read_reply_tree(spark, root).drop("path", "n_rows")


def reply_tree(spark, sf) -> str:
    """A reply folder with every case: all runs of F2, a '900' file, a file of half length, a run
    with a text seed in a nested folder, a second file of one run, and a file that is no CSV."""
    root = scratch(spark, "tree")
    r = write_once(fx.replies(spark, sf))           # five sets of run files come from it

    def run(model, seed):
        return r.filter((F.col("model") == model) & (F.col("seed") == seed))

    coupled = run("m8b", fx.COUPLED_SEED)
    # one task writes a run: the runs of a folder are written side by side
    runs = r.withColumn("seed", F.col("seed").cast("string")).unionByName(coupled.withColumn("seed", F.lit("9001"))) \
        .unionByName(coupled.filter("rep < 5").withColumn("seed", F.lit("777")))
    fl.write_reply_tree(runs, root).count()
    fl.write_reply_tree(run("m3b", fx.COUPLED_SEED).withColumns({"seed": F.lit("abc"), "reply": F.lit("B")}), root + "/nested").count()
    second = run("m1b", fx.COUPLED_SEED).withColumn("reply", F.lit("A"))
    fl.write_reply_tree(second, root + "/nested", start=1).count()
    second.select("reply").limit(3).write.mode("overwrite").text(root + "/m8b/notes")
    return root


_TREE = f"""tree as (select model, cast(seed as varchar) seed, 0 nth, qid, rep, reply from f2
  union all select model, '777', 0, qid, rep, reply from f2 where model = 'm8b' and seed = {fx.COUPLED_SEED} and rep < 5
  union all select model, 'abc', 0, qid, rep, 'B' from f2 where model = 'm3b' and seed = {fx.COUPLED_SEED}
  union all select model, cast(seed as varchar), 1, qid, rep, 'A' from f2 where model = 'm1b' and seed = {fx.COUPLED_SEED}),
tq as (select qid, subject, substr('ABCD', answer + 1, 1) correct from f1 where not is_dev),
tfiles as (select model, seed, nth, count(*) n_rows, (select count(*) * {fx.N_REPEATS} from tq) expected from tree group by all),
tscored as (select case when t.seed = '{fx.COUPLED_SEED}' then 'Coupled' else 'Independent' end noise, t.model, t.seed, tq.subject,
   {parse_choice_sql('t.reply')} = tq.correct ok
  from tree t semi join (select * from tfiles where n_rows = expected) g using (model, seed, nth) join tq using (qid))"""


@query("tree_accuracy", sql("""select noise, model, seed, subject, count(*) n, round(avg(cast(ok as int)), 6) accuracy
  from tscored group by all""", ("f1", F1), ("f2", F2), raw=_TREE))
def tree_accuracy(spark, sf):
    """S1 -> J3 -> T4 -> J2 -> A3: accuracy of every (noise, model, seed, subject) from a reply folder."""
    q = fx.questions(spark, sf).filter(~F.col("is_dev"))
    tree = fl.ReplyTree(spark, reply_tree(spark, sf))
    rows = sc.tree_replies(tree.read(sc.accepted_files(tree.files(), q, fx.N_REPEATS)), q, fx.N_REPEATS)
    scores = sc.score(rows, q, fx.COUPLED_SEED, fx.N_REPEATS, guard=False)
    return rounded(scores.groupBy("noise", "model", "seed", "subject").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(F.col("ok").cast("int")).alias("accuracy")))


@query("length_guard", sql("select model, seed, n_rows, cast(expected as bigint) expected, n_rows = expected accepted from tfiles",
                           ("f1", F1), ("f2", F2), raw=_TREE))
def q_length_guard(spark, sf):
    """Length of every run file of a reply folder (row count = questions x repeats)."""
    q = fx.questions(spark, sf).filter(~F.col("is_dev"))
    files = fl.ReplyTree(spark, reply_tree(spark, sf)).files()
    return sc.length_guard(files, q, fx.N_REPEATS, ["model", "seed", "path"]).drop("path")


_CMP_COLS = {"noise": "string", "model_a": "string", "model_b": "string", "seed_a": "bigint", "seed_b": "bigint",
             "winner": "string"}


@query("json_columns", sql("select row_number() over (partition by noise order by seed_a, seed_b, model_a, model_b, winner) - 1 pos, * from f3",
                           ("f3", F3)))
def json_columns(spark, sf):
    """Comparisons written as column-oriented JSON, the two noises apart (positions start
    anew), and scanned back together with typed columns."""
    c = ordinal(fx.comparisons(spark, sf), ["noise"], ["seed_a", "seed_b", "model_a", "model_b", "winner"], "pos")
    paths = [scratch(spark, "cmp-json") for _ in NOISES]
    for n, path in zip(NOISES, paths):
        fl.write_column_json(c.filter(F.col("noise") == n), path)
    return fl.read_column_json(spark, paths, _CMP_COLS).drop("file")


@query("csv_out", sql("select model, seed, qid, rep, reply from f2", ("f2", F2)))
def csv_out(spark, sf):
    """Replies written as CSV partitioned by run (model, seed), scanned back."""
    path = scratch(spark, "csv-out")
    fl.write_runs(fx.replies(spark, sf), path, ("model", "seed"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("qid bigint, rep int, reply string, model string, seed bigint").csv(path)
    return back.select("model", "seed", "qid", "rep", "reply")


@query("json_out", sql("""select f6.question, m.model, m.quant, m.name, f6.pos seed,
  case when m.model = 'm0' and m.quant = 4 and m.name = 'responses_shared_1' then 'again' else a.text end response
from f6 cross join (select 'm' || i model, q quant, 'responses_shared_' || k as name from (select unnest([0, 1]) i) x,
  (select cast(unnest([0, 4]) as int) q) y, (select unnest([1, 2]) k) z) m
left join conversations a on a.conv_id = f6.conv_id and a.turn = f6.turn + 1 and a.role = 'assistant'""", ("f6", F6)))
def json_out(spark, sf):
    """Result rows of two models, two quantisations and two runs written as JSON under (model, quant,
    name) partitions, the models one after the other; then one run is written again and replaces its
    earlier rows, all other runs stay."""
    path = scratch(spark, "json-out")
    q = fx.open_questions(spark, sf)
    a = fx.assistant_turns(spark, sf).withColumnRenamed("turn", "a_turn").withColumnRenamed("conv_id", "a_conv")
    rows = q.join(a, (q.conv_id == a.a_conv) & (a.a_turn == q.turn + 1), "left")
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("quant"), F.lit(f"responses_shared_{i}").alias("name"))
                               for k in (0, 4) for i in (1, 2)])).alias("run")
    rows = rows.select("question", "response", F.col("pos").alias("seed"), runs).select("question", "response", "seed", "run.*")
    keys = ("model", "quant", "name")
    for m in ("m0", "m1"):
        fl.write_runs(rows.withColumn("model", F.lit(m)), path, keys, "json")
    one = rows.filter("quant = 4 and name = 'responses_shared_1'")
    fl.write_runs(one.withColumns({"model": F.lit("m0"), "response": F.lit("again")}), path, keys, "json")
    back = spark.read.schema("question string, response string, seed bigint, model string, quant int, name string").json(path)
    return back.select("question", "model", "quant", "name", "seed", "response")


@query("vocab_io", sql("""select 'joint' part, token a, null b, row_number() over (order by mrank, token_id) - 1 n from (select token, mrank, token_id
  from (select *, row_number() over (partition by token order by mrank, token_id) rn from f4) z where rn = 1) y
union all select 'model', token, model, token_id from f4
union all select 'length', model, null, count(*) from f4 group by model
union all select 'common', m1.model, m2.model, count(t2.token) from (select distinct mrank, model from f4) m1 join (select distinct mrank, model from f4) m2
  on m1.mrank < m2.mrank join f4 t1 on t1.model = m1.model left join f4 t2 on t2.model = m2.model and t2.token = t1.token group by all""", ("f4", F4)))
def vocab_io(spark, sf):
    """Vocabulary tables saved and loaded back, all four."""
    root = scratch(spark, "vocab")
    v = fx.vocabularies(spark, sf)
    fl.save_vocab(v, vo.joint_vocab(v), vo.vocab_size(v), vo.vocab_common(v, fx.VOCAB_LANGS), root)
    t = fl.load_vocab(spark, root)
    none = F.lit(None).cast("string")

    def part(name, df, a, b, n):
        return df.select(F.lit(name).alias("part"), F.col(a).alias("a"), (F.col(b) if b else none).alias("b"), F.col(n).cast("bigint").alias("n"))

    return part("joint", t["joint_vocab"], "token", None, "joint_id").unionByName(part("model", t["model_vocab"], "token", "model", "token_id")) \
        .unionByName(part("length", t["vocab_length"], "model", None, "n")).unionByName(part("common", t["common_tokens"], "model1", "model2", "common"))


@query("model_list", sql("""select lang model, cast(case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end as int) mrank
  from (select distinct lang from documents) z"""))
def model_list(spark, sf):
    """A model list file {"models": [...]} (the document languages in rank order),
    scanned back to (model, mrank)."""
    path = scratch(spark, "models")
    langs = fx.table(spark, sf, "documents").select("lang").distinct()
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    obj = langs.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("lang").alias("m")))),
                                lambda x: x["m"]).alias("models"))
    obj.coalesce(1).write.mode("overwrite").json(path)
    return fl.read_model_list(spark, path)


@query("questions_scan", sql("select qid, subject, question, answer, choices from f1 where not is_dev", ("f1", F1)))
def questions_scan(spark, sf):
    """Question set written partitioned by split; the test split is read back
    (partition pruning)."""
    path = scratch(spark, "questions")
    q = fx.questions(spark, sf).withColumn("split", F.when(F.col("is_dev"), "dev").otherwise("test"))
    q.drop("is_dev").write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).filter(F.col("split") == "test").select("qid", "subject", "question", "answer", "choices")


@query("pos_index", sql("select row_number() over (order by qid) - 1 pos, qid from f1 where not is_dev", ("f1", F1)))
def pos_index(spark, sf):
    """Explicit position index of the test questions."""
    return ru.positions(fx.questions(spark, sf).filter(~F.col("is_dev")).select("qid"), ["qid"]).select("pos", "qid")


@query("first_row", sql("select pos, conv_id, turn, question from f6 where pos = 0", ("f6", F6)))
def first_row(spark, sf):
    """First open question only (debug head)."""
    return ru.first_row(fx.user_turns(spark, sf), ["conv_id", "turn"]).select("pos", "conv_id", "turn", "question")
