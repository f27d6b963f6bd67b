"""Queries of sinks, reports, references and span building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import scalars as S
from lumenloom.operators import reports as R
from lumenloom.operators import runs as U
from lumenloom.operators import spans as P
from lumenloom.plans.registry import Registry
from lumenloom.sources import sinks
from lumenloom.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("""select session_id as trace_id, count(*) as tools from (select session_id, unnest(tools) from flat_events where type = 'assistant' and session_id is not null) group by 1""")
def span_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tool spans of each built trace."""
    return P.build(table(spark, d, "flat_events"), "session_id", "event_id").filter("span_type = 'TOOL'").groupBy("trace_id").agg(F.count("*").alias("tools"))


@query()
def span_tree(spark: SparkSession, d: str) -> DataFrame:
    """Built span trees; ids are hashes of places, so SQL has no equal text for them. Tested for shape."""
    return P.build(table(spark, d, "flat_events"), "session_id", "event_id")


@query("""select unnest(['cost', 'lines', 'tax']) as name, l_orderkey, unnest([c, n, t]) as value from (select l_orderkey, round(sum(l_extendedprice), 2) as c, count(*)::double as n, round(sum(l_tax), 4) as t from lineitem group by 1)""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.count("*").cast("double").alias("lines"), F.round(F.sum("l_tax"), 4).alias("tax"))
    return sinks.metric_rows(runs, "l_orderkey", ["cost", "lines", "tax"])


@query("""with b as (select c_custkey, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') as base from customer), n as (select *, row_number() over (partition by base order by c_custkey) as n from b)
select c_custkey, case when n = 1 then base else base || '-' || n end as slug from n""")
def run_slugs(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_slugs(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "slug")


@query("""select c_custkey, case when lo < hi then case when c_acctbal = hi then 'best' when c_acctbal = lo then 'worst' else 'other' end end as colour
from (select *, min(c_acctbal) over (partition by c_nationkey) as lo, max(c_acctbal) over (partition by c_nationkey) as hi from customer)""")
def rank_colours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", R.rank_colour("c_acctbal", ["c_nationkey"]).alias("colour"))


@query("""with e as (select doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '([a-z]+/[a-z_]+\\.(?:py|sh|json))', 1))) as target from documents where text is not null)
select target, count(*) as documents from e group by 1""")
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many documents refer to each file."""
    texts = table(spark, d, "documents").filter("text is not null").withColumn("key", F.col("doc_id").cast("string"))
    return R.references(texts, "key", "text", r"([a-z]+/[a-z_]+\.(?:py|sh|json))").groupBy("target").agg(F.count("*").alias("documents"))


@query()
def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """Added and deleted lines between each document and the one before of its source: sequence matching has no SQL."""
    rows = table(spark, d, "documents").select("doc_id", "source", "text", F.floor(F.col("doc_id") / 1000).alias("block"))
    # blocks keep a large source out of one task; the first document of a block meets the last of the block before
    last = rows.groupBy("source", "block").agg(F.max_by("text", "doc_id").alias("last"))
    carried = last.select("source", "block", F.lag("last").over(Window.partitionBy("source").orderBy("block")).alias("carried"))
    inside = Window.partitionBy("source", "block").orderBy("doc_id")
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("inside", F.lag("text").over(inside))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "block")]
    rows = rows.alias("a").join(carried.alias("b"), same, "left").withColumn("old", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("inside")))
    return rows.select("doc_id", R.diff_stats("old", "text").alias("s")).select("doc_id", "s.added", "s.deleted")


@query()
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object inside each document, by a balanced scan."""
    rows = table(spark, d, "documents").filter("contains(text, '{')").select("doc_id", R.extract_json("text").alias("document"))
    return rows.filter("document is not null")


@query("""select l_orderkey, to_json(map(['discount', 'reward', 'tax'], [round(avg(l_discount), 6), round(avg(l_quantity) / 50, 6), round(avg(l_tax), 6)])) as document from lineitem group by 1""")
def reward_documents(spark: SparkSession, d: str) -> DataFrame:
    """Reward and metrics of each case as a JSON document, read back as an ordered map for comparison."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity") / 50, 6).alias("reward"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))
    documents = sinks.reward_documents(rows.select("l_orderkey", "reward"), sinks.metric_rows(rows, "l_orderkey", ["discount", "tax"]), "l_orderkey")
    back = F.map_from_entries(F.array_sort(F.map_entries(F.from_json("document", "map<string,double>"))))
    return documents.select("l_orderkey", F.to_json(back).alias("document"))


@query("""with p(price_model, pi, pc, po) as (values ('1', 0.001, 0.0001, 0.002), ('a/2', 0.002, 0.0002, 0.004), ('3', 0.003, 0.0003, 0.006)),
t as (select l_suppkey, 'a/' || (l_linenumber % 5) as model, l_quantity * 10 as i, l_quantity * 4 as c, l_tax * 100 as o from lineitem),
f as (select t.*, coalesce(w.pi, r.pi) as pi, coalesce(w.pc, r.pc) as pc, coalesce(w.po, r.po) as po from t left join p w on w.price_model = t.model left join p r on r.price_model = split_part(t.model, '/', 2))
select l_suppkey, round(sum(greatest(i - c, 0) * pi + c * pc + o * po), 4) as cost_usd from f group by 1""")
def estimated_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("1", 0.001, 0.0001, 0.002), ("a/2", 0.002, 0.0002, 0.004), ("3", 0.003, 0.0003, 0.006)], "price_model string, per_input double, per_cached double, per_output double")
    turns = table(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("a/"), F.col("l_linenumber") % 5).alias("model"), (F.col("l_quantity") * 10).alias("input_tokens"), (F.col("l_quantity") * 4).alias("cached_tokens"), (F.col("l_tax") * 100).alias("output_tokens"))
    return U.estimated_cost(turns, prices, "l_suppkey", "model").select("l_suppkey", F.round("cost_usd", 4).alias("cost_usd"))


@query("""with r as (select session_id, list(distinct coalesce(t.input_json ->> '$.file_path', '')) as paths from (select session_id, unnest(tools) as t from flat_events where session_id is not null) where json_valid(t.input_json) group by 1),
e as (select session_id, list(json_extract_string(input_json, '$.file_path')) as want from tool_calls where json_valid(input_json) and json_extract_string(input_json, '$.file_path') is not null group by 1)
select session_id, round(len(list_filter(want, lambda w: len(list_filter(coalesce(paths, []), lambda p: p = w or ends_with(p, '/' || w) or ends_with(w, '/' || p))) > 0)) / len(want)::double, 6) as coverage from e left join r using (session_id)""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the files that a session's calls name which its events have read."""
    path = lambda c: F.try_variant_get(F.try_parse_json(c), "$.file_path", "string")
    tools = table(spark, d, "flat_events").filter("session_id is not null").select("session_id", F.explode("tools").alias("t")).filter(F.try_parse_json("t.input_json").isNotNull())
    read = tools.groupBy("session_id").agg(F.collect_set(F.coalesce(path("t.input_json"), F.lit(""))).alias("paths"))
    calls = table(spark, d, "tool_calls").select("session_id", path("input_json").alias("p")).filter("p is not null")
    cases = calls.groupBy("session_id").agg(F.collect_list("p").alias("want")).join(read, "session_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return U.coverage(cases, "want", "paths").select("session_id", F.round("coverage", 6).alias("coverage"))


@query("""with r(rule_no, pattern, f) as (values (1, 'Read', null), (2, 'Web*', null), (3, 'Bash', 'make [a-m]'), (4, '*', 'zz'), (5, 'Bash', null))
select row_id, (select min(rule_no) from r where (name = pattern or (ends_with(pattern, '*') and starts_with(name, left(pattern, len(pattern) - 1)))) and (f is null or regexp_matches(coalesce(input_json, ''), f))) as rule_no from tool_calls""")
def tool_handlers(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "Read", None), (2, "Web*", None), (3, "Bash", "make [a-m]"), (4, "*", "zz"), (5, "Bash", None)], "rule_no int, pattern string, input_filter string")
    return U.handlers(table(spark, d, "tool_calls").select("row_id", "name", F.col("input_json").alias("input")), rules, "row_id").select("row_id", "rule_no")


@query("""with t as (select distinct trace_id, name as run_tag, start_time_unix_nano as begun from spans where name is not null), l as (select trace_id from spans where span_type = 'LLM')
select run_tag, arg_min(trace_id, (begun, trace_id)) as trace_id from t where trace_id not in (select trace_id from l) group by 1""")
def unlinked_traces(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "spans")
    return U.unlinked_traces(spans.select("trace_id", F.col("name").alias("run_tag"), F.col("start_time_unix_nano").alias("at")), spans.filter("span_type = 'LLM'"))


@query("""select l_suppkey, l_returnflag, coalesce(sum(l_linenumber), 0)::bigint as input_tokens, coalesce(sum(case when l_linenumber > 3 then l_linenumber end), 0)::bigint as output_tokens, round(sum(case when l_linenumber > 6 then l_tax end), 6) as cost_usd from lineitem group by 1, 2""")
def usage_merged(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", n.alias("input_tokens"), F.when(n > 3, n).alias("output_tokens"), F.when(n > 6, F.col("l_tax")).alias("cost_usd"))
    return U.merged_usage(rows, "l_suppkey", "l_returnflag").withColumn("cost_usd", F.round("cost_usd", 6))
