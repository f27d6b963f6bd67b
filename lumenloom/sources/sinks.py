"""Sinks: partitioned summaries, reward documents, long metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_summary(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions that rows belong to, by the commit protocol of the file format."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def merged_summary(summary: Column, key: str, value: Column) -> Column:
    """A summary (JSON text of an object, or null) with one of its top-level keys set to a JSON value; the others stay."""
    members = F.coalesce(F.from_json(summary, "map<string,string>"), F.create_map().cast("map<string,string>"))
    document = F.try_parse_json(summary)
    kept = F.filter(F.map_keys(members), lambda k: k != key)
    raw = F.try_variant_get(document, "$", "map<string,variant>")
    parts = F.transform(kept, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.coalesce(F.to_json(F.try_element_at(raw, k)), F.lit("null"))))
    own = F.concat(F.lit(f'"{key}":'), F.coalesce(value, F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(own)), ","), F.lit("}"))


def scrubbed(rows: DataFrame) -> DataFrame:
    """rows with NaN as null in every column of doubles, for JSON."""
    return rows.withColumns({f.name: no_nan(F.col(f.name)) for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")})


def markdown(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """Lines (line_no, line) of a Markdown table of a bounded report, in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = rows.select(F.row_number().over(Window.orderBy(order)).alias("line_no"), cells.alias("line"))
    head = [(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def no_nan(value: Column) -> Column:
    """NaN as null, for JSON."""
    return F.when(~F.isnan(value), value)


def reward_documents(rewards: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """One JSON document for each case: its reward beside its metrics (name, value)."""
    named = metrics.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", no_nan(F.col("value")))))).alias("m"))
    whole = F.map_concat(F.coalesce("m", F.create_map().cast("map<string,double>")), F.create_map(F.lit("reward"), no_nan(F.col("reward"))))
    return rewards.join(named, key, "left").select(key, F.to_json(whole).alias("document"))


def metric_rows(runs: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Long rows (key, name, value) of the metrics of a run, nulls left out."""
    return runs.unpivot(key, names, "name", "value").filter("value is not null")


def feedback(traces: DataFrame, results: DataFrame, on: str, source: str, cap: int = 500) -> DataFrame:
    """One row for each trace and judge result of its run, the rationale cut."""
    return traces.join(results, on).select("trace_id", F.concat_ws("/", "case_id", "judge").alias("name"), "value", F.left("rationale", F.lit(cap)).alias("rationale"), F.lit(source).alias("source_id"))


def pulled_feedback(assessments: DataFrame, own: list[str]) -> DataFrame:
    """The last assessment of each name from others; a bare name is keyed by its trace."""
    name = F.when(F.contains("name", F.lit("/")), F.col("name")).otherwise(F.concat_ws("/", "trace_id", "name"))
    return assessments.filter(~F.col("source_id").isin(own)).groupBy(name.alias("name")).agg(F.max_by("value", "at").alias("value"))
