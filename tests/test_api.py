"""The entries for users over a folder of runs."""

import json

import pytest
from pyspark.sql import functions as F

from lumenloom import api
from lumenloom.sources import sinks


def _runs(root):
    for run, model, value in (("r1", "m1", 5), ("r2", "m1", 4), ("r3", "m2", 2)):
        folder = root / run
        folder.mkdir(parents=True)
        (folder / "summary.yaml").write_text(json.dumps({"per_case": {c: {"s": {"value": value - k}, "g": {"value": True}} for k, c in enumerate(("a", "b"))}}))
        (folder / "run_result.json").write_text(json.dumps({"model": model, "cost_usd": 0.5 * value}))
        (folder / "events.jsonl").write_text("\n".join([json.dumps({"type": "assistant", "message": {"id": "x", "content": [{"type": "text", "text": f"t{n}"}]}}) if n != 5 else "" for n in range(40)] + ["broken"]))


def test_runs_from_files_to_analysis(spark, tmp_path):
    pytest.importorskip("yaml")
    _runs(tmp_path / "runs")
    runs = api.ingest(spark, str(tmp_path / "runs")).register("x_")
    assert spark.sql("select count(*) from x_events where type = 'assistant'").first()[0] == 3 * 39
    numbers = [r["line_no"] for r in runs.lines.filter("run_id = 'r1'").orderBy("line_no").collect()]
    assert numbers == [n for n in range(41) if n != 5] and runs.events.filter("run_id = 'r2' and text = 't7'").count() == 1
    levels = runs.run_results.select("run", F.try_variant_get("doc", "$.model", "string").alias("model"), F.try_variant_get("doc", "$.cost_usd", "double").alias("cost_usd"))
    result = api.analyze(runs.summaries, levels.select("run", "model"), ["model"], levels.select("run", "cost_usd"))
    assert result.method == "repeated measures" and {r["model"]: (r["cost"], r["n"]) for r in result.summaries.collect()} == {"m1": (2.25, 4), "m2": (1.0, 2)}
    both = api.compare_models(levels, runs.results, ["cost_usd"], "s")
    assert [r["model"] for r in both.order.orderBy("place").collect()] == ["m1", "m2"] and both.cases.filter("judge = 's'").count() == 4
    bounds = spark.createDataFrame([("s", "min_mean", 9.0), ("g", "min_pass_rate", 0.5)], "judge string, rule string, bound double")
    report = api.report_tables(runs.results, bounds, runs.results)
    assert {r["judge"]: (r["status"], r["delta"]) for r in report.judges.collect()} == {"s": ("breach", 0.0), "g": ("pass", 0.0)} and report.cases.count() == 2


def test_long_files_are_numbered_over_blocks(spark, tmp_path):
    text = "".join(f'{{"n": {n}, "pad": "{"x" * 90}"}}\n' for n in range(20_000))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = api.transcript_files(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        wrong = lines.filter(F.col("line_no") != F.get_json_object("line", "$.n").cast("int")).count()
        assert wrong == 0 and lines.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", float("nan"))], "k string, v double")
    assert {r["k"]: r["v"] for r in sinks.scrubbed(df).collect()} == {"b": 1.0, "a": None}
    assert [r["line"] for r in sinks.markdown(sinks.scrubbed(df), ["k", "v"], F.desc("v")).orderBy("line_no").collect()] == ["| k | v |", "|---|---|", "| b | 1.0 |", "| a |  |"]
    first, tally = api.pairwise(spark.createDataFrame([("c", "A", "B"), ("d", "A", "A")], "case_id string, ab string, ba string"))
    assert {r["case_id"]: r["winner"] for r in first.collect()} == {"c": "A", "d": "tie"} and tally.first()["wins_a"] == 1
