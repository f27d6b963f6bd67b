"""Cases, runs and trajectories as tables: wide case records, conditions of experiments, fields of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions.scalars import condition_id, strict_number
from lumenloom.operators import judging as J
from lumenloom.sources.files import judge_results, yaml_as_json

#: Longest text of a tool result that is kept.
RESULT_TEXT = 4000


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, size) of all files below root, those of modified copies of cases too; bytes that are no UTF-8 are named, not kept."""
    # folders that begin with an underscore are only listed where they are named
    copies = f"{root.rstrip('/')}/*/_modified"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(copies)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    places = [root, copies] if found is not None and len(found) else [root]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    return files.select("path", readable(F.col("content"), F.col("length")).alias("text"), F.col("length").alias("size"))


def readable(content: Column, length: Column) -> Column:
    """Text of bytes, or a note of how many there are where they are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.concat(F.lit("(binary content, "), length.cast("string"), F.lit(" bytes)")))


def documents_of(files: DataFrame) -> DataFrame:
    """files with doc, the object of a YAML or JSON file; null for other files and unreadable ones."""
    name = F.lower("path")
    body = F.when(name.rlike(r"\.ya?ml$"), yaml_as_json(F.when(name.rlike(r"\.ya?ml$"), F.col("text")))).when(name.endswith(".json"), F.col("text"))
    doc = F.try_parse_json(body)
    return files.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))


def by_case(files: DataFrame, root: str) -> DataFrame:
    """files with case_id, the first folder below root, and name, the path below that."""
    rest = F.regexp_extract("path", "(?:^|/)" + root.strip("/").replace(".", r"\.") + r"/([^/]+)/(.+)$", 1), F.regexp_extract("path", "(?:^|/)" + root.strip("/").replace(".", r"\.") + r"/([^/]+)/(.+)$", 2)
    return files.withColumns({"case_id": rest[0], "name": rest[1]}).filter("case_id != ''")


def field_of(cases: DataFrame, source: str) -> DataFrame:
    """(case_id, value) of `file:dotted.path` or `file:__file__` for each case that has the file; null if nothing is there."""
    name, _, path = source.partition(":")
    rows = cases.filter(F.col("name") == name)
    if path == "__file__":
        return rows.select("case_id", F.col("text").alias("value"))
    steps = "".join(f'["{p}"]' for p in path.split("."))
    found = F.try_variant_get(F.col("doc"), "$" + steps, "variant")
    return rows.select("case_id", F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found)).alias("value"))


#: Where the input of a case stands, best first (fixed values), and stems that are no inputs.
INPUTS = ["input.yaml", "input.yml", "input.json"]
NO_INPUTS = ["answers", "reference", "expected", "gold"]


def inputs(cases: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """(case_id, name, doc) of the input of each case: the first of the usual names, else the first readable data file by name.

    skip: more stems that are no inputs, such as files of the workspace.
    """
    place = F.coalesce(*[F.when(F.col("name") == n, k) for k, n in enumerate(INPUTS)], F.lit(len(INPUTS)))
    stem = F.regexp_extract("name", r"^([^/]+)\.(?:ya?ml|json)$", 1)
    rows = cases.filter("doc is not null").withColumns({"_place": place, "_stem": stem}).filter((F.col("_place") < len(INPUTS)) | ((F.col("_stem") != "") & ~F.col("_stem").isin([*NO_INPUTS, *(skip or [])])))
    return rows.groupBy("case_id").agg(F.min_by(F.struct("name", "doc"), F.struct("_place", "name")).alias("b")).select("case_id", "b.name", "b.doc")


_METRICS = {"exit_code": "bigint", "cost_usd": "double", "num_turns": "bigint", "duration_s": "double"}


def case_records(cases: DataFrame, run_result: Column | None = None, events: list[str] | None = None) -> DataFrame:
    """One wide row for each case: annotations, input, metrics, files by name, and which file holds its events.

    cases: (case_id, name, text, size, doc). A metric that the case's own run_result.json holds, even as null,
    beats that of the run (a variant). Files of modified copies, below _modified/, replace those of the same
    name. events: names of event files, best first.
    """
    events = events or ["events.json", "events.jsonl"]
    plain = F.regexp_replace("name", "^_modified/", "")
    known = ["annotations.yaml", "run_result.json", "stdout.log", "stderr.log", "hook_outputs.yaml", *INPUTS, *events]
    ranked = cases.withColumns({"_name": plain, "_own": (~F.col("name").startswith("_modified/")).cast("int")})
    one = ranked.groupBy("case_id", "_name").agg(F.min_by(F.struct("text", "size", "doc"), F.col("_own")).alias("f"))
    pick = lambda n, c: F.max_by(F.when(F.col("_name") == n, F.col(f"f.{c}")), F.when(F.col("_name") == n, F.lit(1)))
    is_output = ~F.col("_name").isin(known) & ~F.col("_name").startswith("steps/")
    out = one.groupBy("case_id").agg(
        pick("annotations.yaml", "doc").alias("annotations"), pick("run_result.json", "doc").alias("_result"), pick("hook_outputs.yaml", "doc").alias("hook_outputs"),
        pick("stdout.log", "text").alias("stdout"), pick("stderr.log", "text").alias("stderr"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_output, F.struct("_name", "f.text"))))).alias("files"),
        F.min(F.coalesce(*[F.when(F.col("_name") == n, k) for k, n in enumerate(events)])).alias("_events"),
        F.array_sort(F.collect_set(F.nullif(F.regexp_extract("_name", "^steps/([^/]+)/", 1), F.lit("")))).alias("steps"),
    )
    run = run_result if run_result is not None else F.lit(None).cast("variant")
    has = lambda k: F.coalesce(F.map_contains_key(F.try_variant_get("_result", "$", "map<string,variant>"), k), F.lit(False))
    metrics = {k: F.when(has(k), F.try_variant_get("_result", f"$.{k}", t)).otherwise(F.try_variant_get(run, f"$.{k}", t)) for k, t in _METRICS.items()}
    out = out.withColumns(metrics).withColumn("events_file", F.get(F.array(*map(F.lit, events)), F.col("_events"))).drop("_result", "_events")
    return out.join(inputs(cases).select("case_id", F.col("doc").alias("input")), "case_id", "left")


def conditions(summaries: DataFrame, levels: DataFrame, factors: list[str], costs: DataFrame | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, costs): analysis rows (case_id, replication, composite, condition_id, factors) of runs, and the mean cost of each condition.

    summaries: (run, doc) of summary files; levels: (run, a column for each factor), runs without any level are
    left out. Runs of the same levels are replications, numbered by the name of the run. The composite of a case
    is its default reward.
    """
    some = F.coalesce(*[F.col(f).cast("string") for f in factors]).isNotNull()
    shown = {f: F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in factors}
    runs = levels.filter(some).withColumn("condition_id", condition_id(shown))
    judged = judge_results(summaries.join(runs.select("run"), "run", "left_semi"))
    with_cases = judged.select("run").distinct()
    numbered = runs.join(with_cases, "run", "left_semi").withColumn("replication", F.row_number().over(Window.partitionBy("condition_id").orderBy("run")) - 1)
    rewards = J.compose_reward(judged, "run", "case_id", ranges=ranges).withColumnRenamed("reward", "composite")
    rows = rewards.join(numbered, "run").select("case_id", "replication", "composite", "condition_id", *factors)
    if costs is None:
        return rows, numbered.groupBy("condition_id").agg(F.lit(None).cast("double").alias("cost"))
    return rows, numbered.join(costs.select("run", "cost_usd"), "run").groupBy("condition_id").agg(F.avg("cost_usd").alias("cost")).filter("cost is not null")


def only_artifact(files: DataFrame, root: str, name: str = "anova.json") -> DataFrame:
    """The artifact at root, else the only one below it; several below it are none."""
    rows = files.filter(F.col("path").endswith("/" + name)).withColumn("_top", F.col("path").endswith(f"{root.rstrip('/')}/{name}"))
    count = rows.agg(F.count("*").alias("_n"), F.coalesce(F.bool_or("_top"), F.lit(False)).alias("_any"))
    return rows.crossJoin(F.broadcast(count)).filter("_top or (not _any and _n = 1)").drop("_top", "_n", "_any")  # one row


def trace_documents(traces: DataFrame, documents: DataFrame) -> DataFrame:
    """Traces with the longest document of their run, of equals the first by name."""
    best = documents.groupBy("run_name").agg(F.min_by("content", F.struct(-F.length("content"), F.col("name"))).alias("content"))
    return traces.join(best, "run_name", "left")


def trace_inputs(traces: DataFrame, most: int = 10) -> DataFrame:
    """The newest traces, at most `most`, that have a prompt: a listing, the limit is the feature and comes first."""
    return traces.orderBy(F.desc("at"), "trace_id").limit(most).filter("coalesce(trim(prompt), '') != ''")


def _steps(trajectories: DataFrame, key: str, source: str) -> DataFrame:
    """(key, step_no, step) of the steps of one source of trajectory documents."""
    rows = trajectories.select(key, F.posexplode(F.try_variant_get("doc", "$.steps", "array<variant>")).alias("step_no", "step"))
    return rows.filter(F.try_variant_get("step", "$.source", "string") == source)


def _text(value: str, path: str) -> Column:
    """A member that is a text with something in it, trimmed."""
    raw = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.nullif(F.trim(F.try_variant_get(value, path, "string")), F.lit("")))


def user_steps(trajectories: DataFrame, key: str) -> DataFrame:
    """(key, step_no, message, timestamp) of the user's steps with a message."""
    return _steps(trajectories, key, "user").select(key, "step_no", _text("step", "$.message").alias("message"), F.try_variant_get("step", "$.timestamp", "string").alias("timestamp")).filter("message is not null")


def reasoning_steps(trajectories: DataFrame, key: str) -> DataFrame:
    """(key, step_no, reasoning, timestamp) of the agent's steps with reasons."""
    return _steps(trajectories, key, "agent").select(key, "step_no", _text("step", "$.reasoning_content").alias("reasoning"), F.try_variant_get("step", "$.timestamp", "string").alias("timestamp")).filter("reasoning is not null")


def tool_data(trajectories: DataFrame, key: str, cap: int = RESULT_TEXT) -> DataFrame:
    """(key, tool_use_id, arguments, result) of the agent's calls: the last arguments and the last result of each id, results cut at cap."""
    steps = _steps(trajectories, key, "agent")
    inner = lambda path: F.posexplode(F.try_variant_get("step", path, "array<variant>")).alias("pos", "x")
    arguments = F.try_variant_get("x", "$.arguments", "variant")
    calls = steps.select(key, "step_no", inner("$.tool_calls")).select(
        key, "step_no", "pos", F.try_variant_get("x", "$.tool_call_id", "string").alias("tool_use_id"), F.when(F.schema_of_variant(arguments).startswith("OBJECT"), F.to_json(arguments)).alias("arguments"), F.lit(None).cast("string").alias("result")
    )
    seen = steps.select(key, "step_no", inner("$.observation.results")).select(
        key, "step_no", "pos", F.try_variant_get("x", "$.source_call_id", "string").alias("tool_use_id"), F.lit(None).cast("string").alias("arguments"), F.left(_text("x", "$.content"), F.lit(cap)).alias("result")
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("step_no", "pos"))).alias(c)
    return calls.unionByName(seen).filter("coalesce(tool_use_id, '') != ''").groupBy(key, "tool_use_id").agg(last("arguments"), last("result")).filter("arguments is not null or result is not null")


def opaque_metrics(documents: DataFrame, key: str) -> DataFrame:
    """Metrics of a runner that only leaves a document: any of them may be missing or of another type."""
    number = lambda k: strict_number(F.col("doc"), f"$.{k}").alias(k)
    return documents.select(key, *map(number, ("cost_usd", "num_turns", "input_tokens", "output_tokens", "duration_s")))


def end_times(events: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, tool_use_id, ended) of tool calls: the last completed notification where there is one, else the last result."""
    stamp = F.col("timestamp").try_cast("timestamp")
    notified = (F.col("type") == "system") & (F.col("subtype") == "task_notification") & (F.col("status") == "completed")
    rows = events.filter("coalesce(tool_use_id, '') != ''")
    return rows.groupBy(*scope, "tool_use_id").agg(
        F.coalesce(F.max_by(stamp, F.when(notified & stamp.isNotNull(), F.col("position"))), F.max_by(stamp, F.when((F.col("type") == "tool_result") & stamp.isNotNull(), F.col("position")))).alias("ended")
    ).filter("ended is not null")
