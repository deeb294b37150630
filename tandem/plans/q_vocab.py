"""Vocabulary queries (FIXTURE F4: one vocabulary per document language)."""

from __future__ import annotations

from tandem.operators import vocab as vo
from tandem.plans.oracle import F4, sql, sql_list
from tandem.plans.registry import query
from tandem.sources import fixtures as fx

LANGS = fx.VOCAB_LANGS
_PAIRS = " union all ".join(f"select '{a}' model1, '{b}' model2" for i, a in enumerate(LANGS)
                            for j, b in enumerate(LANGS) if i < j)
_JV = """fv as (select token, mrank, token_id from (select *, row_number() over (partition by token order by mrank, token_id) rn
  from f4) z where rn = 1),
jv as (select token, row_number() over (order by mrank, token_id) - 1 joint_id from fv)"""


def vocab(spark, sf):
    return fx.vocabularies(spark, sf)


@query("vocab_size", sql("select mrank, model, count(*) n from f4 group by all", ("f4", F4)))
def q_vocab_size(spark, sf):
    """A1: vocabulary size per model."""
    return vo.vocab_size(vocab(spark, sf))


@query("vocab_common", sql(f"""select p.model1, p.model2, cast(coalesce(c.common, 0) as bigint) common from ({_PAIRS}) p
  left join (select a.model model1, b.model model2, count(*) common from f4 a join f4 b on a.token = b.token and a.mrank < b.mrank
             group by all) c on c.model1 = p.model1 and c.model2 = p.model2""", ("f4", F4)))
def q_vocab_common(spark, sf):
    """A2 + J7 + T1: common tokens of every model pair."""
    return vo.vocab_common(vocab(spark, sf), LANGS)


@query("vocab_union", sql("select distinct token from f4", ("f4", F4)))
def q_vocab_union(spark, sf):
    """Union of all vocabularies."""
    return vo.vocab_union(vocab(spark, sf))


@query("joint_vocab", sql("select token, joint_id from jv", ("f4", F4), raw=_JV))
def q_joint_vocab(spark, sf):
    """W1 + W8: joint vocabulary ids by first appearance."""
    return vo.joint_vocab(vocab(spark, sf))


@query("joint_lookup", sql("select model, mrank, token_id, joint_id from f4 join jv using (token)", ("f4", F4), raw=_JV))
def q_joint_lookup(spark, sf):
    """Model token id to joint id mapping."""
    v = vocab(spark, sf)
    return vo.joint_lookup(v, vo.joint_vocab(v))
