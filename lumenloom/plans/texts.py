"""Queries of references, templates, patterns and texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import scalars as S
from lumenloom.functions import texts as X
from lumenloom.operators import transcripts as E
from lumenloom.operators import validation as W
from lumenloom.plans.registry import Registry
from lumenloom.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").withColumn("key", F.col("doc_id").cast("string"))


@query(r"""with p as (select doc_id, regexp_replace(text, 'https?://\S+', ' ', 'g') as t from documents where text is not null),
e as (select doc_id, list_distinct(regexp_extract_all(t, '([a-z]+/[a-z_]+\.(?:py|sh))', 1)) as s, list_distinct(regexp_extract_all(t, '([a-z]+/[a-z_]+\.[a-z]+)', 1)) as w from p)
select doc_id::varchar as source, unnest(s) as target, 'strong' as confidence from e union all select doc_id::varchar, unnest(list_filter(w, lambda x: not list_contains(s, x))), 'weak' from e""")
def reference_strength(spark: SparkSession, d: str) -> DataFrame:
    """Files that documents refer to, surely or only by form."""
    return W.skill_references(_texts(spark, d), "key", "text", [r"([a-z]+/[a-z_]+\.(?:py|sh))"], r"([a-z]+/[a-z_]+\.[a-z]+)")


@query(r"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\{\{-?\s*([a-zA-Z_][a-zA-Z0-9_]*)', 1))), ',') as variables from documents
where text is not null and regexp_matches(text, '\{\{-?\s*[a-zA-Z_]') and not contains(text, '{%')""")
def template_variables(spark: SparkSession, d: str) -> DataFrame:
    """Variables of the templates among the documents that have no statements."""
    rows = _texts(spark, d).filter(F.col("text").rlike(r"\{\{-?\s*[a-zA-Z_]") & ~F.contains("text", F.lit("{%")))
    return rows.select("doc_id", F.array_join(W.template_variables(F.col("text")), ",").alias("variables"))


@query(r"""with k as (select ['Read', 'Write', 'Bash', 'Grep', 'WebFetch'] as tools), f as (select doc_id, lower(text) as t, list_concat(list_filter(tools, lambda x: contains(lower(text), lower(x))), regexp_extract_all(text, '(mcp__\w+(?:__\w+)*(?:\*)?)', 1)) as found from documents, k where text is not null)
select doc_id, array_to_string(case when len(found) > 0 then found when contains(t, 'script') or contains(t, 'api') then ['Bash'] else ['*'] end, ',') as patterns from f""")
def tool_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.array_join(W.tool_patterns(F.col("text"), ["Read", "Write", "Bash", "Grep", "WebFetch"]), ",").alias("patterns"))


_U = r"""with o as (select * from (select line_id, case when json_valid(line) then line::json end as j from transcript_lines) where json_type(j) = 'OBJECT') """


@query(_U + r""", c as (select line_id, j -> '$.message.content' as c from o where j ->> '$.type' in ('user', 'assistant')),
p as (select line_id, string_agg(trim(t), e'\n\n' order by pos) as t from (select line_id, generate_subscripts(l, 1) as pos, unnest(l) ->> '$.text' as t, unnest(l) ->> '$.type' as y from (select line_id, json_extract(c, '$[*]') as l from c where json_type(c) = 'ARRAY')) where y = 'text' and length(trim(t)) > 0 group by 1)
select c.line_id, case when json_type(c) = 'VARCHAR' then trim(c ->> '$') else coalesce(p.t, '') end as text from c left join p using (line_id)""")
def user_texts(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of the messages of transcript lines."""
    rows = E.parsed(table(spark, d, "transcript_lines")).filter(E.text("$.type").isin("user", "assistant"))
    return rows.select("line_id", X.user_text(F.try_variant_get("v", "$.message.content", "variant")).alias("text"))


@query("""select o_custkey, string_agg(e'\n### ' || name || e'\n\n' || o_orderstatus || e'\n', '' order by name) as outputs from (select *, o_orderpriority || '/' || o_orderkey as name from orders) group by 1""")
def output_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a case as one text, file by file."""
    name = F.concat_ws("/", "o_orderpriority", "o_orderkey")
    files = table(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("o_orderstatus")))).alias("m"))
    return files.select("o_custkey", X.output_blocks(F.col("m")).alias("outputs"))


@query("""select p_partkey, trim(regexp_replace('make ' || p_name || '  of ' || p_brand || ' ' || case when p_size > 25 then p_size::varchar else '' end, '[ \t]+', ' ', 'g')) as prompt from part""")
def filled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template filled from the columns of each case, one field optional."""
    part = table(spark, d, "part")
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 25, F.col("p_size"))}
    return part.select("p_partkey", X.filled("make {name}  of {brand} {size?}", fields).alias("prompt"))


@query("""select p_partkey, case when p_name like '%a' then 'ends' when p_type like 'STANDARD%' or p_type like 'S%' then 'other' else '' end as kind from part""")
def artifact_types(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_name").endswith("a"), "x.end").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", W.artifact_type(name, {"x.end": "ends", "S*": "other"}).alias("kind"))


@query("""select doc_id, replace(replace(text, '\\n', e'\n'), '\\t', e'\t') as text from documents where text is not null""".replace("\\\\", "\\"))
def unescaped_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", S.unescaped(F.col("text")).alias("text"))


@query("""with r as (select *, case when type = 'assistant' and (length(trim(coalesce(text, ''))) > 0 or length(trim(coalesce(thinking, ''))) > 0) or type = 'tool_result' then 1 else 0 end as cut from flat_events where session_id is not null and coalesce(parent_tool_use_id, '') = ''),
s as (select *, sum(cut) over (partition by session_id order by event_id rows unbounded preceding) as c from r),
t as (select session_id, event_id, c, generate_subscripts(tools, 1) - 1 as tool_pos, unnest(tools) as t from s where type = 'assistant')
select session_id, event_id, tool_pos::int as tool_pos, t.name as name, (dense_rank() over (partition by session_id order by c))::int as batch from t""")
def tool_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of root-level tool calls."""
    events = table(spark, d, "flat_events").filter("session_id is not null")
    return E.tool_batches(events, ["session_id"], "event_id").select("session_id", "event_id", "tool_pos", "name", "batch")


@query("""select session_id, case when length(c) > 500 then left(c, 500) || '[truncated]' else c end as conversation from (select session_id, string_agg(text, e'\n\n' order by event_id) as c from flat_events where type = 'assistant' and session_id is not null and length(text) > 0 group by 1)""")
def conversation_capped(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a session up to a cap; what begins beyond it is never gathered."""
    rows = table(spark, d, "flat_events").filter("type = 'assistant' and session_id is not null")
    return E.conversation_text(rows, ["session_id"], ["event_id"], "text", cap=500)


@query("""with e as (select * from flat_events where type = 'assistant' and coalesce(parent_tool_use_id, '') = '' and session_id is not null),
g as (select session_id, event_id, 0 as pos, 'thinking' as kind, null as said, false as agent from e where length(trim(thinking)) > 0 union all
  select session_id, event_id, 1, 'text', trim(text), false from e where length(trim(text)) > 0 union all
  select session_id, event_id, 2, 'calls', null, len(list_filter(tools, lambda t: t.name = 'Agent')) > 0 from e where len(tools) > 0),
r as (select *, kind = 'text' and regexp_matches(split_part(said, e'\n', 1), '(?i)^[A-Z]+-\\d+\\s+(?:created|submitted|reviewed|processed).*\\d+/\\d+\\s+(?:complete|done)|waiting for|agents? (?:are |is )?(?:still )?(?:running|creating|processing)') as report,
  lag(kind) over (partition by session_id order by event_id, pos) as prev from g),
s as (select *, coalesce(kind = 'text' and not report or kind = 'calls' and prev = 'thinking', false) as sure from r),
b as (select *, sum(sure::int) over (partition by session_id order by event_id, pos rows unbounded preceding) as grp from s),
a as (select *, coalesce(max(agent::int) over (partition by session_id, grp order by event_id, pos rows between unbounded preceding and 1 preceding), 0) as busy from b),
n as (select *, sum((sure or report and busy = 0)::int) over (partition by session_id order by event_id, pos rows unbounded preceding) as step from a)
select session_id, step::bigint as step, count(*) filter (kind = 'text') as texts, count(*) filter (kind = 'calls') as calls from n where kind <> 'thinking' group by 1, 2""")
def agent_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each session with their texts and turns of calls."""
    steps = E.agent_steps(table(spark, d, "flat_events").filter("session_id is not null"), ["session_id"], "event_id").filter("kind != 'thinking'")
    return steps.groupBy("session_id", "step").agg(F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "calls").alias("calls"))


@query("""with e as (select session_id, event_id, unnest(case when length(thinking) > 0 and length(text) > 0 then [e'[thinking]\n' || thinking, text] when length(thinking) > 0 then [e'[thinking]\n' || thinking] when length(text) > 0 then [text] end) as said,
  generate_subscripts(case when length(thinking) > 0 and length(text) > 0 then [1, 2] when length(thinking) > 0 or length(text) > 0 then [1] end, 1) as part from flat_events where type = 'assistant' and coalesce(parent_tool_use_id, '') = '' and session_id is not null)
select session_id, string_agg(said, e'\n\n' order by event_id, part) as conversation from e group by 1""")
def thinking_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with the thoughts before the texts."""
    return E.thinking_conversation(table(spark, d, "flat_events").filter("session_id is not null"), ["session_id"], ["event_id"])
