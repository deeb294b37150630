"""DuckDB text of the derived fixtures (same rows as :mod:`tandem.sources.fixtures`)."""

from __future__ import annotations

from tandem.functions.hashing import uniform_sql as U
from tandem.sources.fixtures import (CMP_MODELS, CMP_STRENGTH, COUPLED_SEED, DEV_KEYS, LOGIT_MODELS, MC_MODELS,
                                     N_REPEATS)


def sql_list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


F1 = f"""select p_partkey qid, p_type subject, p_name question, cast(p_size % 4 as int) answer,
  [p_brand||'-A', p_brand||'-B', p_brand||'-C', p_brand||'-D'] choices, p_partkey <= {DEV_KEYS} is_dev
from part"""

_M = ",".join(f"({r},'{n}',{s}e0,cast({seed} as bigint))" for r, n, s, seed in MC_MODELS)
F2 = f"""with q as (select p_partkey qid, cast(p_size % 4 as int) answer from part where not (p_partkey <= {DEV_KEYS})),
m as (select * from (values {_M}) v(mrank, model, skill, iseed)),
nz as (select unnest(['Coupled','Independent']) noise),
rp as (select cast(unnest(range(0, {N_REPEATS})) as int) rep),
r as (select noise, model, qid, rep, answer,
        case when noise = 'Coupled' then cast({COUPLED_SEED} as bigint) else iseed end seed,
        case when (case when noise = 'Coupled' then {U("'c'", "qid", "rep")} else {U("'i'", "model", "qid", "rep")} end) < skill
             then substr('ABCD', answer + 1, 1) else substr('ABCD', (answer + 1) % 4 + 1, 1) end letter,
        {U("'style'", "noise", "model", "qid", "rep")} st
      from q cross join m cross join nz cross join rp)
select model, seed, qid, rep,
  case when st < 0.50e0 then letter when st < 0.60e0 then letter||'.' when st < 0.70e0 then '"'||letter||'"'
       when st < 0.80e0 then letter||') because' when st < 0.90e0 then letter||chr(10)||'since'
       when st < 0.94e0 then 'The answer is '||letter when st < 0.98e0 then lower(letter) else null end reply
from r"""

_K = len(CMP_STRENGTH)
_S = "[" + ",".join(f"{s}e0" for s in CMP_STRENGTH) + "]"
F3 = f"""with c0 as (select case when l_linestatus = 'F' then 'Coupled' else 'Independent' end noise,
   cast(l_suppkey % {_K} as int) a, cast((l_suppkey + 1 + l_partkey % {_K - 1}) % {_K} as int) b,
   l_orderkey seed_a, cast(l_linenumber as bigint) seed_b,
   {U("'cmp'", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")} u
  from lineitem),
c1 as (select *, {_S}[a + 1] sa, {_S}[b + 1] sb,
         case when noise = 'Coupled' then 0.015e0 * abs(b - a) else 0e0 end eff from c0)
select noise, 'model'||a model_a, 'model'||b model_b, seed_a, seed_b,
  case when u < 0.30e0 + (sa - sb) / 2 - eff then 'A' when u < 0.60e0 - 2 * eff then 'B' else 'Tie' end winner
from c1"""

F4 = """with t as (select distinct case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end mrank,
    lang model, tok token from (select lang, unnest(string_split(text, ' ')) tok from documents) z where tok <> '')
select mrank, model, token, row_number() over (partition by mrank, model order by token) - 1 token_id from t"""

F5 = f"""with e as (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 pos from embeddings)
select cast(vec_id % {LOGIT_MODELS} as int) mrank, cast(floor(vec_id / {LOGIT_MODELS}) as bigint) unit,
  cast(pos as int) joint_id, cast(x as double) logit
from e where (pos + vec_id % {LOGIT_MODELS}) % 4 <> 0"""

F6 = """select conv_id, turn, text question, row_number() over (order by conv_id, turn) - 1 pos
from conversations where role = 'user'"""

F7 = """select user_id unit, row_number() over (partition by user_id order by event_id) - 1 step, event_type token
from events"""

# Canonical comparisons (P7) in SQL, used by several oracles.
CANON = f"""r0 as (select *, list_position({sql_list(CMP_MODELS)}, model_a) - 1 ra,
                 list_position({sql_list(CMP_MODELS)}, model_b) - 1 rb from f3),
canon as (select noise,
   case when ra > rb then model_b else model_a end model_a, case when ra > rb then model_a else model_b end model_b,
   case when ra > rb then seed_b else seed_a end seed_a, case when ra > rb then seed_a else seed_b end seed_b,
   case when ra > rb and winner = 'A' then 'B' when ra > rb and winner = 'B' then 'A' else winner end winner,
   cast(least(ra, rb) as int) mrank_a, cast(greatest(ra, rb) as int) mrank_b
  from r0 where ra is not null and rb is not null),
counts as (select noise, model_a, model_b, mrank_a, mrank_b, count(*) n,
   cast(sum(case when winner = 'A' then 1 else 0 end) as bigint) wins_a,
   cast(sum(case when winner = 'B' then 1 else 0 end) as bigint) wins_b,
   cast(sum(case when winner = 'Tie' then 1 else 0 end) as bigint) ties
  from canon group by all),
oriented as (select noise, model_a model, model_b opponent, mrank_a mrank, mrank_b orank, wins_a wins, wins_b losses, n, ties from counts
  union all select noise, model_b, model_a, mrank_b, mrank_a, wins_b, wins_a, n, ties from counts)"""


def sql(body: str, *ctes: tuple[str, str], raw: str = "") -> str:
    """``with name as (sql), ... [raw ctes] body``."""
    parts = [f"{name} as ({text})" for name, text in ctes]
    if raw:
        parts.append(raw)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def lit_double(x: float) -> str:
    return f"cast('{x!r}' as double)"
