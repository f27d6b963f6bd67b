"""Queries of the text problems over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm import conversations, leakage, residue, tokenize, truncation
from lumenloom.session import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.values(table(spark, sf_dir, "flat_events"), "flat_events", "event_id", ["content", "text"]).unionByName(
        truncation.values(table(spark, sf_dir, "documents"), "documents", "doc_id", ["text"])
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stop before their end."""
    return truncation.cut_values(truncation.probe(_values(spark, sf_dir))).select("src_table", "row_id", "field_name")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut values for each source."""
    probed = truncation.probe(_values(spark, sf_dir))
    return truncation.rates(probed, truncation.cut_values(probed))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every conversation that stays, in order."""
    return conversations.turns(table(spark, sf_dir, "chat_messages")).select("session_id", "turn_no", "row_id")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-leaf paths of all messages."""
    return conversations.paths(table(spark, sf_dir, "chat_messages"))


def p3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings, orphans and cyclic messages of every session."""
    return conversations.shapes(table(spark, sf_dir, "chat_messages"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens for each source."""
    return tokenize.token_counts(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation item the number of documents it leaked into."""
    return leakage.report(p8_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold residue instead of content."""
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p3_found": p3_found, "p3_paths": p3_paths, "p3_shapes": p3_shapes, "p7_ids": p7_ids, "p7_counts": p7_counts, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found}
#: Messages without surplus copies, in the terms of the operator, and whether their pointer names none of them.
_MESSAGES = r"""
with keyed as (
  select *, nullif(lower(trim(id, e' \t\n\r')), '') as mid, nullif(lower(trim(reply_to, e' \t\n\r')), '') as up,
         lower(trim(role, e' \t\n\r')) as r, trim(timestamp) as t
  from chat_messages where session_id is not null),
kept as (
  select * from keyed where mid is null
  union all
  select * from keyed where mid is not null
  qualify row_number() over (partition by mid order by received_at nulls last, row_id) = 1),
m as (
  select session_id, row_id, mid, up,
    case when r in ('user', 'human', 'customer') then 'user' when r in ('assistant', 'ai', 'model', 'bot') then 'assistant'
         when r in ('system', 'developer') then 'system' when r in ('tool', 'function', 'tool_result') then 'tool' end as who,
    coalesce(regexp_matches(content, '[^\s\x{0085}\x{00a0}\x{00ad}\x{180e}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]'), false) as seen,
    case when regexp_full_match(t, '\d{9,11}') then t::bigint * 1000000 when regexp_full_match(t, '\d{12,14}') then t::bigint * 1000
         when regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*') then epoch_us(try_cast(t as timestamptz)) end as ts
  from kept),
flags as (select m.*, up is not null and not exists (select 1 from m b where b.session_id = m.session_id and b.mid = m.up) as orphan from m)"""
#: The messages that a beginning leads to, with their distance from it and the rows above them.
_DOWN = (
    _MESSAGES.replace("with keyed", "with recursive keyed", 1)
    + """, one as (select session_id, row_id, coalesce(mid, '#' || row_id) as mid, case when orphan then null else up end as up, orphan, ts from flags),
down as (
  select session_id, mid, row_id, [row_id] as way from one where up is null
  union all
  select o.session_id, o.mid, o.row_id, list_append(d.way, o.row_id) from one o join down d on o.session_id = d.session_id and o.up = d.mid)"""
)
ORACLES: dict[str, str] = {
    "p3_paths": _DOWN
    + """ select session_id, row_id as leaf_row_id, generate_subscripts(way, 1)::int as step_no, unnest(way) as row_id from down d
where not exists (select 1 from one o where o.session_id = d.session_id and o.up = d.mid)""",
    "p3_shapes": _DOWN
    + """ select o.session_id, count(*) as messages, count(*) filter (o.up is null) as beginnings, count(*) filter (o.orphan) as orphans,
  count(*) filter (d.mid is null) as cyclic, count(*) filter (o.ts < b.ts) as out_of_time
from one o left join down d on o.session_id = d.session_id and o.mid = d.mid left join one b on o.session_id = b.session_id and o.up = b.mid group by 1""",
    "p3_found": _MESSAGES
    + r""",
good as (
  select session_id from flags group by 1
  having not bool_or(who is null or not seen or ts is null or orphan) and bool_or(who = 'user')
     and arg_min(who, (ts, row_id)) filter (who <> 'system') = 'user'),
talk as (
  select session_id, who, lead(who) over (partition by session_id order by ts, row_id) as nxt
  from flags join good using (session_id) where who in ('user', 'assistant')),
stay as (select session_id from good where session_id not in (select session_id from talk where who = 'user' and nxt is distinct from 'assistant'))
select session_id, (row_number() over (partition by session_id order by ts, row_id))::int as turn_no, row_id from flags join stay using (session_id)""",
}
