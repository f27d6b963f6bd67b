"""File sources: transcripts, run folders, trials, cases. Malformed input is tolerated by rule, never fatal."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # YAML sources then give empty documents
    yaml = None

_RUN = r"([^/]+)/[^/]+$"


def _document(text: object, is_yaml: bool) -> str | None:
    if not isinstance(text, str):
        return None
    try:
        value = json.loads(text) if not is_yaml else yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if yaml else None
    except Exception:  # noqa: BLE001 - any unreadable document counts as none
        return None
    return json.dumps(value, default=str) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def yaml_as_json(text: pd.Series) -> pd.Series:
    """A YAML mapping as JSON text; null for anything else."""
    return text.map(lambda t: _document(t, True))


def documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, run, doc variant) of every file of one name below root; doc is null where it is unreadable."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    text = F.decode(F.col("content"), "UTF-8")
    body = yaml_as_json(text) if name.endswith((".yaml", ".yml")) else text
    doc = F.try_parse_json(body)
    return files.select("path", F.regexp_extract("path", _RUN, 1).alias("run"), F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc).alias("doc"))


def transcript_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines (run_id, file_name, line_no, line) of transcript files; numbers follow the file, not the partition.

    Large files are read in blocks by many tasks. A line's number is its place in its block and the number of
    lines of the blocks before; only one row for each block is ordered by file. Blank lines count but are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = lines.join(blocks, ["path", "block"]).withColumn("line_no", (F.col("at") - F.col("first") + F.col("before")).cast("int"))
    return numbered.select(F.regexp_extract("path", _RUN, 1).alias("run_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "line_no", "line").filter("trim(line) != ''")


def judge_results(summaries: DataFrame) -> DataFrame:
    """Long judge results (run, case_id, judge, value union) of the per_case maps of summaries."""
    cases = summaries.select("run", F.explode(F.try_variant_get("doc", "$.per_case", "map<string,map<string,variant>>")).alias("case_id", "judges"))
    rows = cases.select("run", "case_id", F.explode("judges").alias("judge", "r"))
    kind = F.schema_of_variant(F.try_variant_get("r", "$.value", "variant"))
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return rows.select(
        "run", "case_id", "judge",
        F.when(kind == "BOOLEAN", "bool").when(number, "num").when(kind == "STRING", "str").alias("value_kind"),
        F.when(kind == "BOOLEAN", F.try_variant_get("r", "$.value", "boolean")).alias("value_bool"),
        F.when(number, F.try_variant_get("r", "$.value", "double")).alias("value_num"),
        F.when(kind == "STRING", F.try_variant_get("r", "$.value", "string")).alias("value_str"),
        F.try_variant_get("r", "$.error", "string").alias("error"),
    )


def by_precedence(case: Column, run: Column, key: str) -> Column:
    """A case metric where its key is present, even null, else that of the run (maps)."""
    return F.when(F.map_contains_key(case, key), F.try_element_at(case, F.lit(key))).otherwise(F.try_element_at(run, F.lit(key)))


def trials(rewards: DataFrame, results: DataFrame, failures: DataFrame, unjudged_member: str = "unjudged") -> DataFrame:
    """Trials by folder: a reward document, or an error record where only a failure is there; others are dropped.

    unjudged_member: the flag of a reward document that was never judged; its reward is null.
    """
    key = lambda df: df.withColumn("trial", F.regexp_replace("path", r"/(verifier/)?[^/]+$", ""))
    r = key(rewards).select("trial", F.col("doc").alias("reward_doc"))
    x = key(results).select("trial", F.col("doc").alias("result_doc"))
    f = key(failures).select("trial", F.lit(True).alias("failed")).distinct()
    both = r.join(f, "trial", "full").join(x, "trial", "left").filter("reward_doc is not null or failed")
    unjudged = F.coalesce(F.try_variant_get("reward_doc", f"$.{unjudged_member}", "boolean"), F.lit(False))
    task = F.try_variant_get("result_doc", "$.task_name", "string")
    name = F.regexp_extract("trial", r"([^/]+)$", 1)
    tokens = F.try_variant_get("result_doc", "$.agent_result.n_input_tokens", "bigint")
    cached = F.coalesce(F.try_variant_get("result_doc", "$.agent_result.n_cache_tokens", "bigint"), F.lit(0))
    return both.select(
        "trial",
        F.coalesce(F.element_at(F.split(task, "/"), -1), F.regexp_replace(name, "__[^_]*$", "")).alias("case_id"),
        F.when(~unjudged, F.try_variant_get("reward_doc", "$.reward", "double")).alias("reward"),
        F.col("reward_doc").isNull().alias("errored"),
        F.try_variant_get("result_doc", "$.agent_result.cost_usd", "double").alias("cost_usd"),
        F.when(tokens.isNotNull(), F.greatest(F.lit(0), tokens - cached)).alias("fresh_tokens"),
    )


def job(trial_rows: DataFrame) -> DataFrame:
    """One row for a job: mean reward of judged trials, cost, tokens, errors."""
    return trial_rows.agg(
        F.count("*").alias("trials"), F.avg("reward").alias("mean_reward"), F.sum("cost_usd").alias("cost_usd"), F.sum("fresh_tokens").alias("fresh_tokens"), F.count_if("errored").alias("errors")
    )


def object_cases(keys: DataFrame, prefix: str) -> DataFrame:
    """Keys of an object store by case, the first segment behind the prefix; keys without a second are dropped."""
    rest = F.regexp_replace("key", "^" + prefix.rstrip("/") + "/", "")
    parts = F.split(rest, "/")
    return keys.filter((F.size(parts) > 1) & (F.element_at(parts, -1) != "")).groupBy(parts[0].alias("case_id")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
