"""The registered queries of the training-data operators: each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import (chat, decontaminate, filter_audit, hard_negatives, html_text, language_id, lattice_dup, line_dedup,
                        near_dup, packing, substring_dedup, top_k, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_chat_format", """
    with logged as (select distinct conv_id, turn, role, text from conversations),
    ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from logged),
    said as (select conv_id, pos, (case when role is null then 'n' else 'v' || length(role) || ':' || role end)
               || (case when text is null then 'n' else 'v' || length(text) || ':' || text end) as piece,
               '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as shown from ordered),
    pre as (select conv_id, pos, string_agg(piece, '' order by pos) over (partition by conv_id order by pos) as prefix,
              count(*) over (partition by conv_id) as n from said),
    full_ as (select min(conv_id) as conv_id, prefix, n, count(*) as n_copies from pre where pos = n group by prefix, n),
    kept as (select * from full_ f where not exists (select 1 from pre p where p.pos < p.n and p.pos = f.n and p.prefix = f.prefix))
    select k.conv_id, cast(k.n as bigint) as n_turns, cast(k.n_copies as bigint) as n_copies, string_agg(s.shown, '' order by s.pos) as chat
    from kept k join said s on s.conv_id = k.conv_id group by k.conv_id, k.n, k.n_copies""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


@query("op3_lattice_near_dup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of cosine 0.9 or more."""
    return lattice_dup.linked_vectors(_read(spark, sf_dir, "embeddings"))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


@query("op5_minhash_near_dup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents (shingle sets, Jaccard 0.75 or more)."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


@query("op7_substring_dedup", """
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
    pos as (select doc_id, words, unnest(range(0, greatest(len(words) - 12, 0))) as i from w),
    win as (select doc_id, i, array_to_string(words[i + 1:i + 13], ' ') as s from pos),
    low as (select s, min(doc_id) as d from win group by s),
    gone as (select distinct win.doc_id, win.i + o.o as i from win join low using (s), (select unnest(range(0, 13)) as o) o where low.d < win.doc_id),
    word as (select doc_id, unnest(words) as x, unnest(range(0, len(words))) as i from w),
    stay as (select word.* from word anti join gone on word.doc_id = gone.doc_id and word.i = gone.i),
    kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by i) as t from stay group by doc_id)
    select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(kept.n, 0) as bigint) as n_removed,
           sha256(coalesce(kept.t, '')) as kept_sha256
    from w left join kept on kept.doc_id = w.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows found in an earlier document."""
    return substring_dedup.drop_repeated_passages(_read(spark, sf_dir, "documents"), with_text=False)


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a window near a benchmark item."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query("op9_line_dedup", f"""
    with lines as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
    keyed as (select *, {_LOWER.format(f'trim(line, {_SPACE})')} as k from lines),
    common as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
    select doc_id, cast(count(*) as bigint) as n_lines,
           cast(count(*) filter (k in (select k from common)) as bigint) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (k not in (select k from common)), '')) as kept_sha256
    from keyed group by doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more."""
    return line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents"), with_text=False)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    dicts = language_id.learn_dictionaries(docs, F.coalesce(~held_out, F.lit(False)))
    got = language_id.identify(docs, dicts)
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


_FINITE = "vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"
_INTEGERS = "[cast(floor(256 * cast(x as double)) as bigint) for x in embedding]"


@query("op11_hard_negatives", f"""
    with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_INTEGERS} as v
               from embeddings where label is not null and {_FINITE}),
    e as (select vec_id, label, unnest(v) as x, unnest(range(len(v))) as i from r),
    s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(sum(a.x * b.x) as bigint) as score
          from e a join e b on a.i = b.i where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id group by all),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
           cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as int) as rank
    from p join s on s.anchor_id = p.anchor_id and not same
      and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    qualify rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op12_filter_audit", """
    with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    f as (select doc_id, part, len(ws) < 100 as a, 100 * len(list_distinct(ws)) < 80 * len(ws) as b,
                 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
                 coalesce(doc_id > min(doc_id) over (partition by t), false) as e from w),
    l as (select doc_id, max(cast(coalesce(quality = 1, false) as int)) as good, max(cast(coalesce(toxic = 1, false) as int)) as toxic
          from labels group by doc_id),
    n as (select part, a, b, c, d, e, coalesce(good, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic, count(*) as n
          from f left join l using (doc_id) group by all),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (select p.x || q.x || r.x || s.x || u.x as o from x p, x q, x r, x s, x u
               where len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
    steps as (select o, k as step, substr(o, k, 1) as letter, substr(o, 1, k - 1) as done from orders, (select unnest([1, 2, 3, 4, 5]) as k) z),
    hit as (select part, o, step, letter, n, good, toxic,
              case letter when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
              (a and contains(done, 'A')) or (b and contains(done, 'B')) or (c and contains(done, 'C'))
                or (d and contains(done, 'D')) or (e and contains(done, 'E')) as gone,
              cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int) + cast(e as int) as n_fails from n, steps),
    y as (select part, o, step, letter, sum(n) filter (not gone and not fails) as kept, sum(n) filter (fails and not gone) as removed,
            sum(n) filter (fails and gone) as redundant, sum(n) filter (fails and n_fails = 1) as unique_fails,
            sum(n) filter (fails and not gone and good) as good_lost, sum(n) filter (fails and not gone and toxic) as toxic_lost
          from hit group by all)
    select part, o as filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept,
           cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
           cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
           cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
           cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley from y""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of five filters in all 120 orders, by language."""
    masks = filter_audit.failure_masks(_read(spark, sf_dir, "documents"))
    return filter_audit.audit_orders(masks, _read(spark, sf_dir, "labels"))


@query("op13_top_k", f"""
    with r as (select distinct vec_id, {_INTEGERS} as v from embeddings where {_FINITE}),
    e as (select vec_id, unnest(v) as x, unnest(range(len(v))) as i from r),
    s as (select a.vec_id as query_id, b.vec_id, cast(sum(a.x * b.x) as bigint) as score
          from e a join e b on a.i = b.i where a.vec_id % 50 = 0 and b.vec_id <> a.vec_id group by all)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
    from s qualify rank <= 5""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all others."""
    return top_k.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
