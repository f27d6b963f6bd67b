"""Flat events from transcript lines, and what is derived from events: tools, reads, usage, batches, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.scalars import RESULT_CAP, is_real_model, truncate
from lumenloom.session import stage


def parsed(lines: DataFrame) -> DataFrame:
    """Transcript lines with v, the parsed object; blank, broken and other lines are dropped."""
    v = F.try_parse_json(F.trim(F.col("line")))
    return lines.withColumn("v", v).filter(F.expr("schema_of_variant(v) like 'OBJECT%'"))


def text(path: str, value: Column | None = None) -> Column:
    return F.try_variant_get(F.col("v") if value is None else value, path, "string")


def flat_events(lines: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """One row for each event (line_id, event_no, type, ...) of both producers.

    An assistant line is one event, a user line one for each tool result, an item line one (a message, or
    thoughts), two (a call and its result) or none (unknown items). Joined text parts, thinking by line, tools
    as an array; results are cut at cap code points with `truncated` set. Turns that a producer only marks as
    completed are folded by turn_results.
    """
    rows = parsed(lines)
    kind = text("$.type")
    blocks = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array())
    bare = F.try_variant_get("v", "$.message.content", "string")
    part = lambda name: F.filter(blocks, lambda b: text("$.type", b) == name)
    joined = lambda name, member, sep: F.array_join(F.transform(part(name), lambda b: text(f"$.{member}", b)), sep)
    # a turn whose thoughts were taken out is not one without thoughts
    thought_of = lambda b: F.when(text("$.type", b) == "thinking", text("$.thinking", b)).when(text("$.type", b) == "redacted_thinking", F.lit("[redacted thinking]"))
    none = F.lit(None)
    shape = (
        "struct<type:string,text:string,thinking:string,tools:array<struct<name:string,id:string,input_json:string>>,"
        "tool_use_id:string,content:string,is_error:boolean,cost_usd:double,num_turns:bigint,subtype:string,model:string>"
    )

    def event(**fields: Column) -> Column:
        names = ["type", "text", "thinking", "tools", "tool_use_id", "content", "is_error", "cost_usd", "num_turns", "subtype", "model"]
        return F.struct(*[fields.get(n, none).alias(n) for n in names]).cast(shape)

    assistant = event(
        type=F.lit("assistant"),
        text=F.when(bare.isNotNull() & (F.size(blocks) == 0), bare).otherwise(joined("text", "text", "")),
        thinking=F.nullif(F.array_join(F.filter(F.transform(blocks, thought_of), lambda t: F.length(t) > 0), "\n"), F.lit("")),
        tools=F.transform(part("tool_use"), lambda b: F.struct(text("$.name", b), text("$.id", b), F.to_json(F.try_variant_get(b, "$.input", "variant")))),
        model=text("$.message.model"),
    )
    inner = lambda b: F.coalesce(
        F.array_join(F.transform(F.filter(F.try_variant_get(b, "$.content", "array<variant>"), lambda c: text("$.type", c) == "text"), lambda c: text("$.text", c)), ""),
        text("$.content", b),
        F.lit(""),
    )
    results = F.transform(
        part("tool_result"),
        lambda b: event(type=F.lit("tool_result"), tool_use_id=text("$.tool_use_id", b), content=inner(b), is_error=F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))),
    )
    done = event(type=F.lit("result"), cost_usd=F.try_variant_get("v", "$.total_cost_usd", "double"), num_turns=F.try_variant_get("v", "$.num_turns", "bigint"))
    system = event(type=F.lit("system"), subtype=text("$.subtype"), model=F.when(text("$.subtype") == "init", text("$.model")))
    item = text("$.item.type")
    member = lambda k: text(f"$.item.{k}")
    raw = lambda k: F.try_variant_get("v", f"$.item.{k}", "variant")
    filled = lambda *ks: F.coalesce(*[F.nullif(member(k), F.lit("")) for k in ks])
    is_a = lambda k, shape: F.coalesce(F.schema_of_variant(raw(k)).startswith(shape), F.lit(False))
    truthy = lambda k: raw(k).isNotNull() & ~F.coalesce(F.to_json(raw(k)), F.lit("null")).isin("null", '""', "false", "0", "{}", "[]")
    as_text = lambda k: F.when(truthy(k), F.coalesce(F.when(is_a(k, "STRING"), member(k)), F.to_json(raw(k))))
    status_failed = F.coalesce(member("status") == "failed", F.lit(False))
    exit_code = F.when(is_a("exit_code", "BIGINT"), F.try_variant_get("v", "$.item.exit_code", "bigint"))
    by_item = lambda *cases: F.coalesce(*[F.when(item == n, v) for n, v in cases])
    tool = by_item(
        ("command_execution", F.lit("Bash")),
        ("mcp_tool_call", F.concat(F.lit("mcp__"), F.coalesce(filled("server", "server_name"), F.lit("mcp")), F.lit("__"), F.coalesce(filled("tool", "name"), F.lit("tool")))),
        ("collab_tool_call", F.coalesce(filled("tool"), F.lit("collaboration"))),
        ("web_search", F.lit("WebSearch")),
        ("file_change", F.lit("Edit")),
    )
    given = by_item(
        ("command_execution", F.to_json(F.struct(F.coalesce(member("command"), F.lit("")).alias("command")))),
        ("mcp_tool_call", F.when(is_a("arguments", "OBJECT"), F.to_json(raw("arguments"))).otherwise(F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(raw("arguments")), F.lit("{}")), F.lit("}")))),
        ("collab_tool_call", F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.to_json(raw(k))) for k in ("prompt", "receiver_thread_ids")]), F.lit("}"))),
        ("web_search", F.to_json(F.struct(F.coalesce(member("query"), F.lit("")).alias("query")))),
        ("file_change", F.concat(
            F.lit('{"changes":'), F.coalesce(F.to_json(raw("changes")), F.lit("[]")),
            F.coalesce(F.concat(F.lit(',"file_path":'), F.to_json(F.try_variant_get("v", "$.item.changes[0].path", "variant"))), F.lit("")), F.lit("}"),
        )),
    )
    output = by_item(
        ("command_execution", F.coalesce(F.when(is_a("aggregated_output", "STRING"), member("aggregated_output")), F.to_json(raw("aggregated_output")), F.lit(""))),
        ("mcp_tool_call", F.coalesce(as_text("result"), as_text("error"), F.lit(""))),
        ("collab_tool_call", F.coalesce(as_text("message"), as_text("status"), F.lit(""))),
        ("web_search", F.coalesce(as_text("result"), F.lit(""))),
        ("file_change", F.coalesce(as_text("status"), F.lit(""))),
    )
    failed = by_item(
        ("command_execution", F.coalesce(exit_code != 0, F.lit(False))), ("mcp_tool_call", truthy("error")),
        ("collab_tool_call", status_failed), ("web_search", F.lit(False)), ("file_change", status_failed),
    )
    number = F.coalesce(member("id"), F.lit(""))
    call = event(type=F.lit("assistant"), text=F.lit(""), tools=F.array(F.struct(tool, number, given)))
    back = event(type=F.lit("tool_result"), tool_use_id=number, content=output, is_error=failed)
    said = event(type=F.lit("assistant"), text=F.when(is_a("text", "STRING"), member("text")).otherwise(""))
    thought = event(type=F.lit("assistant"), text=F.lit(""), thinking=F.coalesce(F.when(is_a("text", "STRING"), member("text")), F.when(is_a("summary", "STRING"), member("summary")), F.lit("")))
    items = F.when(item == "agent_message", F.array(said)).when(item == "reasoning", F.array(thought)).when(tool.isNotNull(), F.array(call, back))
    events = (
        F.when(kind == "assistant", F.array(assistant))
        .when(kind == "user", results)
        .when(kind == "result", F.array(done))
        .when(kind == "system", F.array(system))
        .when(kind == "item.completed", items)
    )
    keep = [c for c in ("line_id", "run_id", "case_id", "file_name", "line_no") if c in lines.columns]
    out = rows.select(*keep, F.when(kind != "result", text("$.timestamp")).alias("timestamp"), F.coalesce(text("$.message.id"), F.when((kind == "item.completed") & (item == "agent_message"), F.nullif(member("id"), F.lit("")))).alias("_msg_id"), text("$.parent_tool_use_id").alias("parent_tool_use_id"), F.when(F.length(text("$.parent_tool_use_id")) > 0, text("$.agent_id")).alias("agent_id"), F.posexplode(events).alias("event_no", "e"))
    return out.select(*keep, "event_no", "timestamp", "_msg_id", "parent_tool_use_id", "agent_id", "e.*").withColumns(
        {
            "truncated": F.coalesce(F.length("content") > cap, F.lit(False)),
            "original_length": F.when(F.length("content") > cap, F.length("content").cast("long")),
            "content": truncate(F.col("content"), cap),
        }
    )


def tool_trace(events: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """One row for each tool call with its step number within a scope."""
    calls = events.select(*scope, *[o for o in order if o not in scope], F.posexplode("tools").alias("tool_pos", "tool"))
    step = F.row_number().over(Window.partitionBy(*scope).orderBy(*order, "tool_pos"))
    return calls.select(*scope, step.alias("step"), F.col("tool.name").alias("name"), F.col("tool.id").alias("id"), F.col("tool.input_json").alias("input_json"))


def tool_names(events: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Tool results with the name of the newest earlier call of the same id, '' if there is none (as-of join)."""
    used = events.select(*scope, F.col(order).alias("_o"), F.explode("tools").alias("t")).select(*scope, "_o", F.col("t.id").alias("tool_use_id"), F.col("t.name").alias("_name"), F.lit(None).cast("long").alias("_row"))
    got = events.filter("type = 'tool_result'").select(*scope, F.col(order).alias("_o"), "tool_use_id", F.lit(None).cast("string").alias("_name"), F.col(order).cast("long").alias("_row"))
    newest = Window.partitionBy(*scope, "tool_use_id").orderBy("_o", F.col("_row").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    both = used.unionByName(got).withColumn("found", F.last("_name", ignorenulls=True).over(newest))
    return both.filter("_row is not null").select(*scope, F.col("_row").alias(order), "tool_use_id", F.coalesce("found", F.lit("")).alias("tool_name"))


def segments(rows: DataFrame, scope: list[str], order: list[str], boundary: Column) -> DataFrame:
    """rows with segment: the number of boundaries up to the row within its scope (gaps and islands)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("segment", F.sum(F.coalesce(boundary, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def conversation_text(rows: DataFrame, scope: list[str], order: list[str], value: str, separator: str = "\n\n", cap: int | None = None) -> DataFrame:
    """Texts of a scope joined in order; nulls and empty texts are left out.

    With a cap only the texts that begin within it are gathered, so a long scope never stands in one row whole.
    """
    there = rows.filter(F.coalesce(F.length(value), F.lit(0)) > 0)
    if cap:
        before = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.sum(F.length(value) + len(separator)).over(before), F.lit(0))
        there = there.withColumn("_begins", begins).filter(F.col("_begins") <= cap + len(separator)).withColumn(value, F.left(value, F.lit(cap + 1))).drop("_begins")
    parts = there.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x[value]), separator)
    return parts.select(*scope, (truncate(joined, cap) if cap else joined).alias("conversation"))


def thinking_conversation(events: DataFrame, scope: list[str], order: list[str], cap: int = 400_000) -> DataFrame:
    """Root-level texts of a scope with the thoughts before them, marked, up to a cap."""
    root = events.filter("type = 'assistant' and coalesce(parent_tool_use_id, '') = ''")
    thought = F.when(F.length("thinking") > 0, F.concat(F.lit("[thinking]\n"), "thinking"))
    parts = root.select(*scope, *[o for o in order if o not in scope], F.posexplode(F.array_compact(F.array(thought, F.when(F.length("text") > 0, F.col("text"))))).alias("_part", "_said"))
    joined = conversation_text(parts, scope, [*order, "_part"], "_said", cap=cap)
    marked = F.regexp_replace("conversation", r"\[truncated\]$", "\n\n[conversation truncated]")
    return joined.withColumn("conversation", F.when(F.length("conversation") > cap, marked).otherwise(F.col("conversation")))


def merge_subagents(main: DataFrame, extra: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Main rows and those sub-agent rows whose message id is new; a repeated one only fills in missing thinking.

    Rows without an id all stay. Order: rows without timestamp last, then the timestamp as text.
    """
    both = main.withColumn("_source", F.lit(0)).unionByName(extra.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    with_id = both.filter("_msg_id is not null")
    w = Window.partitionBy(*scope, "_msg_id").orderBy("_source", *order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = (
        with_id.withColumn("_n", F.row_number().over(w))
        .withColumn("thinking", F.coalesce(F.nullif("thinking", F.lit("")), F.first(F.nullif("thinking", F.lit("")), ignorenulls=True).over(whole)))
        .filter("_source = 0 or _n = 1")
        .drop("_n")
    )
    return kept.unionByName(both.filter("_msg_id is null")).withColumn(
        "position", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col("timestamp").isNull(), "timestamp", "_source", *order))
    ).drop("_source")


def turn_results(lines: DataFrame, scope: list[str], order: str = "line_id") -> DataFrame:
    """One result event (scope, line_id, num_turns, timestamp) for each scope with lines of completed turns, at the last of them."""
    done = parsed(lines).filter(text("$.type").isin("turn.completed", "turn_completed"))
    return done.groupBy(*scope).agg(
        F.max(order).alias(order), F.lit("result").alias("type"), F.lit(None).cast("double").alias("cost_usd"), F.count("*").alias("num_turns"),
        F.max_by(F.struct(text("$.timestamp").alias("t")), F.col(order))["t"].alias("timestamp"),
    )


def turn_usage(lines: DataFrame, scope: list[str]) -> DataFrame:
    """Tokens and turns of completed turns: what came from the cache is no fresh input."""
    done = parsed(lines).filter(text("$.type").isin("turn.completed", "turn_completed"))
    count = lambda n: F.greatest(F.coalesce(F.try_variant_get("v", f"$.usage.{n}", "bigint"), F.lit(0)), F.lit(0))
    given, cached = count("input_tokens"), count("cached_input_tokens")
    return done.groupBy(*scope).agg(
        F.sum(F.greatest(given - cached, F.lit(0))).alias("input"), F.sum(count("output_tokens")).alias("output"), F.sum(cached).alias("cache_read"), F.count("*").alias("num_turns")
    )


_MODEL_STATS = "map<string,struct<inputTokens:bigint,outputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint,costUSD:double>>"


def usage(lines: DataFrame, scope: list[str], order: str = "line_id") -> DataFrame:
    """Tokens, turns, models, cost and usage by model of the assistant and result lines of a scope.

    Tokens are those of the last result line with usage by model, which counts sub-agents too; without one the
    sums over assistant lines, null if they are nil. The cost is that of the last result line that names one,
    even as null. Turns are distinct message ids; stand-in models are no models.
    """
    rows = parsed(lines)
    tokens = lambda n: F.coalesce(F.try_variant_get("v", f"$.message.usage.{n}", "bigint"), F.lit(0))
    kind, model, number = text("$.type"), text("$.message.model"), F.nullif(text("$.message.id"), F.lit(""))
    assistant, result = kind == "assistant", kind == "result"
    real = F.coalesce(is_real_model(F.nullif(model, F.lit(""))), F.lit(False))
    costs = F.try_variant_get("v", "$.total_cost_usd", "variant")
    stats = F.try_variant_get("v", "$.modelUsage", "variant")
    last = lambda value, there: F.max_by(F.when(there, value), F.when(there, F.col(order)))
    has_stats = result & F.coalesce(F.schema_of_variant(stats).startswith("OBJECT"), F.lit(False))
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    grouped = rows.groupBy(*scope).agg(
        *[F.sum(F.when(assistant, tokens(n)).otherwise(0)).alias(f"_{n}") for n in names],
        F.nullif(F.count_distinct(F.when(assistant, number)), F.lit(0)).alias("num_turns"),
        F.array_sort(F.collect_set(F.when(assistant & real, model))).alias("models"),
        last(F.struct(F.try_variant_get("v", "$.total_cost_usd", "double").alias("c")), result & costs.isNotNull())["c"].alias("cost_usd"),
        last(F.try_variant_get("v", "$.modelUsage", _MODEL_STATS), has_stats).alias("_stats"),
    )
    by_model = F.when(F.size("_stats") > 0, F.col("_stats"))
    total = lambda n: F.aggregate(F.map_values(by_model), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[n], F.lit(0)))
    given = (F.col("_input_tokens") != 0) | (F.col("_output_tokens") != 0)
    fields = ["inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens"]
    return grouped.select(
        *scope, *[F.coalesce(total(f), F.when(given, F.col(f"_{n}"))).alias(n) for n, f in zip(names, fields)], "num_turns", "models", "cost_usd", by_model.alias("by_model")
    )


def message_turns(lines: DataFrame, scope: list[str], by_model: bool = False) -> DataFrame:
    """Distinct assistant messages (scope, [model,] _msg_id) of transcript lines, of streams and of sub-agents alike."""
    role = (text("$.type") == "assistant") | (text("$.message.role") == "assistant")
    rows = parsed(lines).filter(role).select(*scope, text("$.message.model").alias("model"), F.nullif(text("$.message.id"), F.lit("")).alias("_msg_id")).filter("_msg_id is not null")
    return rows.filter(is_real_model(F.col("model"))).distinct() if by_model else rows.drop("model").distinct()


def new_turns(stream: DataFrame, extra: DataFrame, scope: list[str]) -> DataFrame:
    """For each scope, and model where both sides name it: turns of the stream, and those of sub-agents that it does not show."""
    keys = [*scope, *(["model"] if "model" in stream.columns else [])]
    fresh = extra.join(stream, [*keys, "_msg_id"], "left_anti")
    both = stream.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.count_if(F.col("_new") == 0).alias("stream_turns"), F.sum("_new").alias("subagent_turns"), F.count("*").alias("turns"))


def run_metrics(runs: DataFrame, cost: str, turns: str, tokens_in: str, tokens_out: str, cache: str, created: str | None = None) -> DataFrame:
    """Cost and output tokens per turn, cache hit rate, cost per million tokens; null where inputs are missing or nil.

    What went into a run are fresh tokens, those read from the cache and those put into it.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(0)) if name else F.lit(0)
    went_in = c(tokens_in) + c(cache) + c(created)
    some = F.col(turns) > 0
    return runs.withColumns(
        {
            "cost_per_turn": F.when(some, F.round(F.try_divide(F.col(cost), F.col(turns)), 6)),
            "output_per_turn": F.when(some & (c(tokens_out) != 0), F.round(F.try_divide(c(tokens_out), F.col(turns)), 2)),
            "cache_hit_rate": F.when(went_in > 0, F.round(F.try_divide(c(cache), went_in), 6)),
            "cost_per_mtok": F.when(went_in + c(tokens_out) > 0, F.round(F.try_divide(F.col(cost) * 1e6, went_in + c(tokens_out)), 4)),
        }
    )


def matching_calls(events: DataFrame, patterns: list[str], keys: list[str]) -> DataFrame:
    """Root-level tool calls whose name holds one of the patterns, each once."""
    rows = events.filter("type = 'assistant' and coalesce(parent_tool_use_id, '') = ''").select(*keys, F.posexplode("tools").alias("tool_pos", "t"))
    held = F.exists(F.array(*[F.lit(p) for p in patterns]).cast("array<string>"), lambda p: F.contains(F.col("t.name"), p))
    return rows.filter(held).select(*keys, "tool_pos", F.col("t.name").alias("name"), F.col("t.input_json").alias("input_json"))


#: Names that producers give to the tools of a kind, and to their arguments (fixed values).
TOOL_KINDS = {
    "read": ["read", "read_file", "readfile", "view", "cat", "open"],
    "write": ["write", "write_file", "writefile", "create", "edit", "multiedit", "str_replace_editor", "update"],
    "exec": ["bash", "shell", "run", "execute", "exec", "command"],
    "skill": ["skill"],
}
ARGUMENTS = {"path": ["file_path", "path", "file", "filename"], "command": ["command", "cmd", "script"], "skill": ["skill", "name", "id"]}


def evidence(events: DataFrame, scope: list[str], order: str) -> DataFrame:
    """What can be verified of a scope: calls by tool, skills in order, commands, files read and written by name, turns and cost of the last result."""
    member = lambda *ks: F.coalesce(*[F.nullif(F.try_variant_get(F.try_parse_json("t.input_json"), f"$.{k}", "string"), F.lit("")) for k in ks])
    calls = events.filter("type = 'assistant'").select(*scope, order, F.posexplode("tools").alias("pos", "t")).filter("coalesce(t.name, '') != ''")
    low = F.lower(F.col("t.name"))
    path = F.element_at(F.split(member(*ARGUMENTS["path"]), "/"), -1)
    of_kind = lambda kind, value: F.when(low.isin(TOOL_KINDS[kind]), value)
    rows = calls.select(
        *scope, order, "pos", F.col("t.name").alias("tool"), of_kind("skill", F.coalesce(member(*ARGUMENTS["skill"]), F.lit("?"))).alias("skill"),
        of_kind("read", path).alias("read"), of_kind("write", path).alias("written"), of_kind("exec", member(*ARGUMENTS["command"])).alias("command"),
    )
    counts = rows.groupBy(*scope, "tool").agg(F.count("*").alias("n")).groupBy(*scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_calls"))
    used = rows.groupBy(*scope).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("skill").isNotNull(), F.struct(order, "pos", "skill")))), lambda x: x["skill"]).alias("skills"),
        F.array_sort(F.collect_set("read")).alias("files_read"), F.array_sort(F.collect_set("written")).alias("files_written"),
        F.array_sort(F.collect_set("command")).alias("commands"),
    )
    done = events.filter("type = 'result'").groupBy(*scope).agg(F.max_by(F.struct(F.coalesce("num_turns", F.lit(0)).alias("turns"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost")), order).alias("r"))
    both = used.join(counts, scope, "left").join(done, scope, "full")
    return both.select(*scope, F.coalesce("r.turns", F.lit(0)).alias("turns"), F.coalesce("r.cost", F.lit(0.0)).alias("cost_usd"), "tool_calls", "skills", "commands", "files_read", "files_written")


def apportion(spans: DataFrame, costs: DataFrame, model: str, cost: str) -> DataFrame:
    """Spans with their share of the cost of their model: cost over the number of its spans."""
    counts = spans.groupBy(model).agg(F.count("*").alias("_n"))
    return spans.join(costs.join(counts, model).select(model, (F.col(cost) / F.col("_n")).alias("span_cost")), model, "left")


def running_total(rows: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """rows with the sum of size over the rows before, in order: within ranges of the order, and over the ranges.

    Only one row for each range is summed in one task.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range").agg(F.sum(size).alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = placed.withColumn("_inside", inside).join(totals.select("_range", offset.alias("_offset")), "_range")
    return both.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_range", "_inside", "_offset")


def route(numbers: DataFrame, batches: DataFrame, number: str, order: str, size: str, bucket: int = 1024) -> DataFrame:
    """Range join: each number to the batch whose running [start, start + size) holds it.

    Both sides meet in buckets of numbers, so it is an equi-join however many batches there are.
    """
    ranges = running_total(batches, order, size, "_start").withColumn("_end", F.col("_start") + F.col(size)).filter("_end > _start")
    ranges = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_start") / bucket), F.floor((F.col("_end") - 1) / bucket))))
    met = numbers.withColumn("_bucket", F.floor(F.col(number) / bucket)).join(ranges, "_bucket")
    return met.filter((F.col(number) >= F.col("_start")) & (F.col(number) < F.col("_end"))).drop("_start", "_end", "_bucket")


#: Tools that start an agent (fixed values).
AGENTS = ["Agent", "Task"]


def tool_batches(events: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Root-level calls (scope, order, tool_pos, name, id) with batch: calls without a text, thoughts or a result between them are one.

    `recent` names the tools that were called since the last text, in order.
    """
    root = events.filter("coalesce(parent_tool_use_id, '') = ''")
    said = (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0) | (F.coalesce(F.length(F.trim("thinking")), F.lit(0)) > 0) if "thinking" in events.columns else F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0
    cuts = (F.col("type") == "assistant") & said | (F.col("type") == "tool_result")
    upto = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visible = (F.col("type") == "assistant") & (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0)
    rows = root.withColumns({"_cut": F.sum(F.coalesce(cuts, F.lit(False)).cast("int")).over(upto), "_text": F.sum(F.coalesce(visible, F.lit(False)).cast("int")).over(upto)})
    calls = rows.filter("type = 'assistant'").select(*scope, order, "_cut", "_text", F.posexplode("tools").alias("tool_pos", "t"))
    rank = F.dense_rank().over(Window.partitionBy(*scope).orderBy("_cut"))
    past = Window.partitionBy(*scope, "_text").orderBy(order, "tool_pos").rowsBetween(Window.unboundedPreceding, -1)
    return calls.select(*scope, order, "tool_pos", F.col("t.name").alias("name"), F.col("t.id").alias("id"), rank.alias("batch"), F.array_distinct(F.collect_list("t.name").over(past)).alias("recent"))


#: Texts that only report on agents at work (fixed patterns): they open no step while agents run.
STATUS = r"(?i)^[A-Z]+-\d+\s+(?:created|submitted|reviewed|processed).*\d+/\d+\s+(?:complete|done)|waiting for|agents? (?:are |is )?(?:still )?(?:running|creating|processing)"


def agent_steps(events: DataFrame, scope: list[str], order: str, status: str = STATUS) -> DataFrame:
    """Segments (scope, order, pos, kind, said, step) of the root-level turns: thoughts, texts and calls with the step they belong to.

    A text opens a step, unless it only reports on agents that the step has started. Calls directly behind thoughts open
    one as well. Thoughts belong to what follows them. Calls before the first text are step 0. All by windows over a
    scope: a report opens a step exactly if no agent was started since the last step that surely opened.
    """
    filled = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    root = events.filter("type = 'assistant' and coalesce(parent_tool_use_id, '') = ''")
    none = F.lit(None).cast("string")
    one = lambda kind, said, agent: F.struct(F.lit(kind).alias("kind"), said.alias("said"), agent.alias("agent"))
    agents = F.exists("tools", lambda t: F.coalesce(t["name"] == "Agent", F.lit(False)))
    parts = F.array_compact(F.array(
        F.when(filled("thinking"), one("thinking", F.trim("thinking"), F.lit(False))), F.when(filled("text"), one("text", F.trim("text"), F.lit(False))),
        F.when(F.size("tools") > 0, one("calls", none, agents)),
    ))
    rows = root.select(*scope, order, "timestamp", F.posexplode(parts).alias("pos", "_seg")).select(*scope, order, "pos", "timestamp", "_seg.*")
    w = Window.partitionBy(*scope).orderBy(order, "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    report = (F.col("kind") == "text") & F.split_part("said", F.lit("\n"), F.lit(1)).rlike(status)
    sure = (F.col("kind") == "text") & ~report | (F.col("kind") == "calls") & F.coalesce(F.lag("kind").over(w) == "thinking", F.lit(False))
    rows = rows.withColumn("_report", report).withColumn("_sure", sure).withColumn("_group", F.sum(F.col("_sure").cast("int")).over(upto))
    inside = Window.partitionBy(*scope, "_group").orderBy(order, "pos").rowsBetween(Window.unboundedPreceding, -1)
    busy = F.coalesce(F.max(F.col("agent").cast("int")).over(inside), F.lit(0)) > 0
    rows = rows.withColumn("_busy", busy).withColumn("_step", F.sum((F.col("_sure") | F.col("_report") & ~F.col("_busy")).cast("int")).over(upto))
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    owner = F.coalesce(F.first(F.when(F.col("kind") != "thinking", F.col("_step")), ignorenulls=True).over(after), F.col("_step"))
    return rows.select(*scope, order, "pos", "timestamp", "kind", "said", F.when(F.col("kind") == "thinking", owner).otherwise(F.col("_step")).alias("step"))
