"""Queries over transcripts, events, spans and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import scalars as S
from lumenloom.functions.shell import command_read_paths
from lumenloom.operators import transcripts as E
from lumenloom.plans.registry import Registry
from lumenloom.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_J = r"""with j as (select line_id, run_id, case_id, case when json_valid(trim(line, e' \t\n\r')) then trim(line, e' \t\n\r') end as j from transcript_lines),
o as (select * from j where json_type(j) = 'OBJECT'),
b as (select line_id, run_id, j, unnest(json_extract(j, '$.message.content[*]')) as b, generate_subscripts(json_extract(j, '$.message.content[*]'), 1) as pos from o where json_type(j, '$.message.content') = 'ARRAY')
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_lines")


@query(_J + """, a as (select line_id, run_id, j ->> '$.type' as t from o)
select type, count(*) as n from (
  select 'assistant' as type from a where t = 'assistant' union all
  select 'tool_result' from b where j ->> '$.type' = 'user' and b ->> '$.type' = 'tool_result' union all
  select t from a where t in ('result', 'system') union all
  select 'assistant' from o where j ->> '$.type' = 'item.completed' and j ->> '$.item.type' in ('agent_message', 'reasoning', 'command_execution', 'mcp_tool_call', 'collab_tool_call', 'web_search', 'file_change') union all
  select 'tool_result' from o where j ->> '$.type' = 'item.completed' and j ->> '$.item.type' in ('command_execution', 'mcp_tool_call', 'collab_tool_call', 'web_search', 'file_change')) group by 1""")
def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Flat events of both producers by type."""
    return E.flat_events(_lines(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query(_J + """select line_id, b ->> '$.id' as id, b ->> '$.name' as name, row_number() over (partition by line_id order by pos) as step
from b where j ->> '$.type' = 'assistant' and b ->> '$.type' = 'tool_use' union all
select line_id, coalesce(j ->> '$.item.id', ''), 'Bash', 1 from o where j ->> '$.type' = 'item.completed' and j ->> '$.item.type' = 'command_execution'""")
def tool_trace(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls of both producers with their step within the line."""
    events = E.flat_events(_lines(spark, d)).filter("type = 'assistant' and tools is not null")
    return E.tool_trace(events, ["line_id"], ["event_no"]).select("line_id", "id", "name", "step")


@query("""with u as (select run_id, session_id, event_id, unnest(tools) as t from flat_events),
r as (select event_id, session_id, tool_use_id from flat_events where type = 'tool_result' and session_id is not null and tool_use_id is not null)
select r.event_id, r.tool_use_id, coalesce((select arg_max(u.t.name, u.event_id) from u where u.session_id = r.session_id and u.t.id = r.tool_use_id and u.event_id < r.event_id and u.t.name is not null), '') as tool_name from r""")
def as_of_tool(spark: SparkSession, d: str) -> DataFrame:
    """Tool name of each result from the newest earlier call of its id."""
    events = table(spark, d, "flat_events").filter("session_id is not null").select("session_id", "event_id", "type", "tools", "tool_use_id")
    return E.tool_names(events, ["session_id"], "event_id").filter("tool_use_id is not null").select("event_id", "tool_use_id", "tool_name")


@query("""select session_id, t.name as tool, count(*) as n from (select session_id, unnest(tools) as t from flat_events) group by 1, 2""")
def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    tools = table(spark, d, "flat_events").select("session_id", F.explode("tools").alias("t"))
    return tools.groupBy("session_id", F.col("t.name").alias("tool")).agg(F.count("*").alias("n"))


@query("""with t as (select event_id, generate_subscripts(tools, 1) - 1 as tool_pos, unnest(tools) as t from flat_events where parent_tool_use_id is null)
select event_id, tool_pos::int as tool_pos, coalesce(t.input_json ->> '$.file_path', t.input_json ->> '$.path') as path from t
where t.name in ('Read', 'Grep') and json_valid(t.input_json) and coalesce(nullif(coalesce(t.input_json ->> '$.file_path', t.input_json ->> '$.path'), ''), '.') <> '.'""")
def read_calls(spark: SparkSession, d: str) -> DataFrame:
    """Paths that root-level Read and Grep calls name."""
    tools = table(spark, d, "flat_events").filter("parent_tool_use_id is null").select("event_id", F.posexplode("tools").alias("tool_pos", "t")).filter("t.name in ('Read', 'Grep')")
    v = F.try_parse_json(F.col("t.input_json"))
    path = F.coalesce(F.try_variant_get(v, "$.file_path", "string"), F.try_variant_get(v, "$.path", "string"))
    return tools.select("event_id", "tool_pos", path.alias("path")).filter("coalesce(path, '') not in ('', '.')")


@query()
def command_reads(spark: SparkSession, d: str) -> DataFrame:
    """Files that Bash commands read or list: shell quoting has no SQL; tested on literal commands."""
    v = F.try_parse_json("input_json")
    tools = table(spark, d, "tool_calls").filter("name = 'Bash'")
    listed = F.coalesce(F.try_variant_get(v, "$.read_paths", "array<string>"), F.array().cast("array<string>"))
    named = command_read_paths(F.try_variant_get(v, "$.command", "string"))
    return tools.select("row_id", F.explode(F.array_distinct(F.concat(named, listed))).alias("path"))


@query("""select session_id, string_agg(text, e'\\n\\n' order by event_id) as conversation from flat_events where type = 'assistant' and parent_tool_use_id is null and session_id is not null and length(text) > 0 group by 1""")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flat_events").filter("type = 'assistant' and parent_tool_use_id is null and session_id is not null")
    return E.conversation_text(rows, ["session_id"], ["event_id"], "text")


@query("""select session_id, left(arg_max(text, event_id), 4000) as last_text from flat_events where type = 'assistant' and length(text) > 0 and session_id is not null group by 1""")
def last_assistant(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flat_events").filter("type = 'assistant' and length(text) > 0 and session_id is not null")
    return rows.groupBy("session_id").agg(F.left(F.max_by("text", "event_id"), F.lit(4000)).alias("last_text"))


@query("""with e as (select *, lower(_msg_id) as k from flat_events where session_id is not null),
f as (select *, row_number() over (partition by session_id, k order by (agent_id is not null)::int, event_id) as n from e where k is not null)
select event_id from f where agent_id is null or n = 1 union all select event_id from e where k is null""")
def merge_subagents(spark: SparkSession, d: str) -> DataFrame:
    """Main events and the sub-agent events whose message id is new."""
    rows = table(spark, d, "flat_events").filter("session_id is not null").select("session_id", "event_id", "agent_id", F.lower("_msg_id").alias("_msg_id"), "thinking", "timestamp")
    return E.merge_subagents(rows.filter("agent_id is null"), rows.filter("agent_id is not null"), ["session_id"], ["event_id"]).select("event_id")


@query("""select doc_id, length(text) as n_chars, case when length(text) > 300 then left(text, 300) || '[truncated]' else text end as cut from documents""")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), S.truncate(F.col("text"), 300).alias("cut"))


@query("""select trace_id, count(*) as spans, count(*) filter (end_time_unix_nano < start_time_unix_nano) as reversed, max(end_time_unix_nano) - min(start_time_unix_nano) as nanos, count(distinct name) as names from spans group by 1""")
def trace_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.count_if(F.col("end_time_unix_nano") < F.col("start_time_unix_nano")).alias("reversed"),
        (F.max("end_time_unix_nano") - F.min("start_time_unix_nano")).alias("nanos"), F.countDistinct("name").alias("names"),
    )


@query("""with s as (select distinct trace_id, span_id, parent_span_id, start_time_unix_nano as a, end_time_unix_nano as b from spans)
select c.trace_id, c.span_id, least(p.b, greatest(p.a, c.a)) as start_ns from s c join s p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id""")
def clamp_spans(spark: SparkSession, d: str) -> DataFrame:
    """Start of each span within its parent's bounds."""
    s = table(spark, d, "spans").select("trace_id", "span_id", "parent_span_id", F.col("start_time_unix_nano").alias("a"), F.col("end_time_unix_nano").alias("b")).distinct()
    p = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    both = s.join(p, ["trace_id", "parent_span_id"])
    return both.select("trace_id", "span_id", F.least("pb", F.greatest("pa", "a")).alias("start_ns"))


@query("""select event_id, epoch_us(try_cast(timestamp as timestamptz)) * 1000 as nanos from flat_events where timestamp is not null""")
def iso_nanos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flat_events").filter("timestamp is not null").select("event_id", S.iso_nanos(F.col("timestamp")).alias("nanos"))


@query("""select run_id, model, count(distinct lower(_msg_id)) as turns from flat_events where type = 'assistant' and _msg_id is not null group by 1, 2 having model is not null and run_id is not null""")
def turns_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flat_events").filter("type = 'assistant' and _msg_id is not null and model is not null and run_id is not null")
    return rows.groupBy("run_id", "model").agg(F.countDistinct(F.lower("_msg_id")).alias("turns"))


@query("""select count(*) as results, count(*) filter (case when json_valid(content) and json_type(case when json_valid(content) then content end) = 'OBJECT' then coalesce(case when json_valid(content) then content end -> '$.error', 'null'::json)::varchar not in ('null', '""', 'false', '0', '{}', '[]') else contains(lower(left(content, 50)), 'error') end) as failed, count(*) filter (is_error) as flagged, sum((length(content) > 100)::int)::bigint as long from flat_events where type = 'tool_result'""")
def tool_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flat_events").filter("type = 'tool_result'")
    return rows.agg(F.count("*").alias("results"), F.count_if(S.tool_failed(F.col("content"))).alias("failed"), F.count_if("is_error").alias("flagged"), F.sum(F.coalesce((F.length("content") > 100).cast("int"), F.lit(0))).alias("long"))


@query("""select case_id, coalesce(max(cost_usd) filter (type = 'result') <= 0.5, false) as within_budget from flat_events where case_id is not null group by 1""")
def cost_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flat_events").filter("case_id is not null")
    return rows.groupBy("case_id").agg(F.coalesce(F.max(F.when(F.col("type") == "result", F.col("cost_usd"))) <= 0.5, F.lit(False)).alias("within_budget"))


@query("""with s as (select session_id, count(*) as n, sum(coalesce((type = 'assistant')::int, 0))::bigint as a from flat_events group by grouping sets ((session_id), ())) select * from s""")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events and assistant events by session and in all."""
    return table(spark, d, "flat_events").rollup("session_id").agg(F.count("*").alias("n"), F.sum((F.col("type") == "assistant").cast("int")).alias("a"))


@query("""select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words from documents where text is not null""")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", S.count_words(F.col("text")).cast("long").alias("words"))


@query("""with f as (select case_id, count(*) as n, sum(o_totalprice) as v from (select o_orderpriority as case_id, o_totalprice from orders where o_orderstatus = 'F') group by 1),
o as (select o_orderpriority as case_id, count(*) as n from orders where o_orderstatus = 'P' group by 1)
select coalesce(f.case_id, o.case_id) as case_id, f.n as current_n, o.n as baseline_n, round((f.n - o.n) / o.n::double * 100, 4) as delta_percent from f full join o on f.case_id = o.case_id""")
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join of current and baseline with the change in percent."""
    orders = table(spark, d, "orders")
    side = lambda status, name: orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("case_id")).agg(F.count("*").alias(name))
    both = side("F", "current_n").join(side("P", "baseline_n"), "case_id", "full")
    return both.withColumn("delta_percent", F.round((F.col("current_n") - F.col("baseline_n")) / F.col("baseline_n") * 100, 4))


@query("""select label, count(*) as n, round(avg(list_sum(list_transform(embedding, lambda x: x::double * x))), 4) as norm2 from embeddings group by 1""")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    norm = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("norm2"))


@query("""with e as (select user_id, ts, event_id, coalesce(epoch(ts - lag(ts) over (partition by user_id order by ts, event_id)) > 1800, true)::int as cut, value from events),
s as (select *, sum(cut) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e)
select user_id, session::bigint as session, count(*) as n, round(sum(value), 6) as value from s group by 1, 2""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user, half an hour apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("cut", F.coalesce(micros - F.lag(micros).over(w) > 1_800_000_000, F.lit(True)))
    return E.segments(rows, ["user_id"], ["ts", "event_id"], F.col("cut")).groupBy("user_id", F.col("segment").alias("session")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
