"""Span trees from flat events: a root for the session, a step for each text, a span for each tool call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_id(*parts: Column) -> Column:
    """The same id on every run: the head of a hash of the place of the span."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def build(events: DataFrame, trace: str, order: str) -> DataFrame:
    """Spans (trace_id, span_id, parent_span_id, name, span_type, start_ns, end_ns) of the events of each trace.

    A visible text opens a step; the tool calls up to the next text belong to it. A call ends with its result,
    or after a second; steps and roots span their children. Times that cannot be read take that of the
    step before. Events need type, text, tools, tool_use_id, timestamp.
    """
    at = F.unix_micros(F.col("timestamp").try_cast("timestamp")) * 1000
    w = Window.partitionBy(trace).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("type") == "assistant") & (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0)
    rows = (
        events.filter(f"{trace} is not null")
        .select(trace, order, "type", "text", "tools", "tool_use_id", at.alias("ns"))
        .withColumn("ns", F.coalesce(F.last("ns", ignorenulls=True).over(past), F.first("ns", ignorenulls=True).over(Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)))
        .withColumn("step", F.sum(opens.cast("int")).over(past))
    )
    ends = rows.filter("type = 'tool_result' and tool_use_id is not null").groupBy(trace, F.col("tool_use_id").alias("id")).agg(F.max("ns").alias("done"))
    calls = rows.filter("type = 'assistant'").select(trace, order, "step", "ns", F.posexplode("tools").alias("pos", "t")).select(trace, order, "pos", "step", F.col("ns").alias("start_ns"), F.col("t.name").alias("name"), F.col("t.id").alias("id"))
    calls = calls.join(ends, [trace, "id"], "left").withColumn("end_ns", F.greatest("start_ns", F.coalesce("done", F.col("start_ns") + 1_000_000_000)))
    root, step = span_id(F.col(trace)), span_id(F.col(trace), F.col("step").cast("string"))
    tools = calls.select(F.col(trace).alias("trace_id"), span_id(F.col(trace), F.col(order).cast("string"), F.col("pos").cast("string")).alias("span_id"), step.alias("parent_span_id"), "name", F.lit("TOOL").alias("span_type"), "start_ns", "end_ns", "step")
    steps = rows.groupBy(trace, "step").agg(F.min("ns").alias("start_ns"), F.max("ns").alias("end_ns"), F.min_by(F.left("text", F.lit(80)), order).alias("name"))
    late = tools.groupBy(F.col("trace_id").alias(trace), "step").agg(F.max("end_ns").alias("late"))
    steps = steps.join(late, [trace, "step"], "left").select(
        F.col(trace).alias("trace_id"), step.alias("span_id"), root.alias("parent_span_id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("step")).alias("name"), F.lit("CHAIN").alias("span_type"), "start_ns", F.greatest("end_ns", "late").alias("end_ns")
    )
    roots = steps.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).select(
        "trace_id", span_id(F.col("trace_id")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("session").alias("name"), F.lit("AGENT").alias("span_type"), "start_ns", "end_ns"
    )
    return roots.unionByName(steps).unionByName(tools.drop("step"))
