"""Transcripts, run folders, spans, reports and sinks."""

import json

from pyspark.sql import functions as F

from lumenloom.operators import reports as R
from lumenloom.operators import runs as U
from lumenloom.operators import spans as P
from lumenloom.operators import transcripts as E
from lumenloom.sources import files, sinks

LINES = [
    {"type": "system", "subtype": "init", "model": "m-1"},
    {"type": "assistant", "timestamp": "2026-03-01T10:00:00Z", "message": {"id": "1", "model": "m-1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "u1", "name": "Read", "input": {"p": 1}}], "usage": {"input_tokens": 3}}},
    {"type": "user", "timestamp": "2026-03-01T10:00:05Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": [{"type": "text", "text": "xy"}, {"type": "image"}]}, {"type": "tool_result", "tool_use_id": "u9", "content": "z" * 30, "is_error": True}]}},
    {"type": "item.completed", "item": {"id": "i1", "type": "command_execution", "command": "ls", "aggregated_output": "out", "exit_code": 1}},
    {"type": "item.completed", "item": {"id": "i2", "type": "agent_message", "text": "hello"}},
    {"type": "result", "total_cost_usd": 0.5, "num_turns": 2},
]


def lines(spark, rows=LINES):
    texts = [json.dumps(r) for r in rows] + ["{broken", "", "[1]"]
    return spark.createDataFrame([(k, "r", t, "x") for k, t in enumerate(texts)], "line_id long, run_id string, line string, v string").drop("v")


def test_flat_events(spark):
    got = [(r["line_id"], r["event_no"], r["type"], r["text"], r["content"], r["is_error"], r["truncated"]) for r in E.flat_events(lines(spark), cap=20).orderBy("line_id", "event_no").collect()]
    assert got == [
        (0, 0, "system", None, None, None, False), (1, 0, "assistant", "ab", None, None, False), (2, 0, "tool_result", None, "xy", False, False),
        (2, 1, "tool_result", None, "z" * 20 + "[truncated]", True, True), (3, 0, "assistant", "", None, None, False), (3, 1, "tool_result", None, "out", True, False),
        (4, 0, "assistant", "hello", None, None, False), (5, 0, "result", None, None, None, False),
    ]
    assert E.flat_events(lines(spark).limit(0)).count() == 0


def test_usage_and_names(spark):
    row = E.usage(lines(spark), ["run_id"]).first()
    assert (row["input_tokens"], row["num_turns"], row["models"], row["cost_usd"]) == (3, 1, ["m-1"], 0.5)
    events = E.flat_events(lines(spark))
    names = {(r["line_id"], r["tool_use_id"]): r["tool_name"] for r in E.tool_names(events, ["run_id"], "line_id").collect()}
    assert names[(2, "u1")] == "Read" and names[(2, "u9")] == ""


def test_span_tree_shape(spark):
    events = E.flat_events(lines(spark)).withColumn("s", F.lit("s1"))
    spans = P.build(events, "s", "line_id").collect()
    ids = {r["span_id"] for r in spans}
    assert len(ids) == len(spans) and sum(r["parent_span_id"] is None for r in spans) == 1
    assert all(r["parent_span_id"] is None or r["parent_span_id"] in ids for r in spans) and all(r["start_ns"] <= r["end_ns"] for r in spans)
    read = next(r for r in spans if r["name"] == "Read")
    assert read["end_ns"] - read["start_ns"] == 5_000_000_000


def test_run_folders(spark, tmp_path):
    for run, body in {"r1": "per_case:\n  c1:\n    j: {value: true}\n    k: {value: 2.5}\n  c2:\n    j: {value: null, error: boom}\n", "r2": "{unclosed", "r3": "- list"}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "summary.yaml").write_text(body)
    docs = files.documents(spark, str(tmp_path), "summary.yaml")
    assert {r["run"]: r["ok"] for r in docs.select("run", F.col("doc").isNotNull().alias("ok")).collect()} == {"r1": True, "r2": False, "r3": False}
    got = {(r["case_id"], r["judge"]): (r["value_kind"], r["value_bool"], r["value_num"], r["error"]) for r in files.judge_results(docs).collect()}
    assert got == {("c1", "j"): ("bool", True, None, None), ("c1", "k"): ("num", None, 2.5, None), ("c2", "j"): (None, None, None, "boom")}


def test_transcript_files_and_sinks(spark, tmp_path):
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "a.jsonl").write_text('{"a": 1}\r\n\n{"b": 2}\n')
    got = [(r["run_id"], r["line_no"], r["line"]) for r in files.transcript_files(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("run7", 0, '{"a": 1}'), ("run7", 2, '{"b": 2}')]
    rows = spark.createDataFrame([("r1", "a", 1.0), ("r2", "a", 2.0)], "run string, judge string, mean double")
    out = str(tmp_path / "summary")
    sinks.write_summary(rows, out, "run")
    sinks.write_summary(spark.createDataFrame([("r2", "b", 9.0)], rows.schema), out, "run")
    assert sorted((r["run"], r["mean"]) for r in spark.read.parquet(out).collect()) == [("r1", 1.0), ("r2", 9.0)]


def test_routes_and_references(spark):
    batches = spark.createDataFrame([(1, 3), (2, 0), (3, 4000)], "b long, n long")
    got = {r["k"]: r["b"] for r in E.route(spark.range(5000).withColumnRenamed("id", "k"), batches, "k", "b", "n").collect()}
    assert got == {k: 1 if k < 3 else 3 for k in range(4003)}
    texts = spark.createDataFrame([("s1", "use /s2 and /x:s3, see http://h/s9"), ("s2", "use /s2"), ("s3", None)], "k string, t string")
    edges = R.references(texts, "k", "t", r"/([a-z0-9:]+)")
    resolved = {(r["source"], r["target"]): r["resolved"] for r in R.resolve(edges, texts, "k").collect()}
    assert resolved == {("s1", "s2"): True, ("s1", "x:s3"): True}
    assert [r["k"] for r in R.orphans(texts, "k", edges).collect()] == ["s1"]


def test_texts():
    assert R.line_changes("a\nb\nc", "a\nx\nc\nd") == (2, 1)
    assert R.json_in('so {bad} then ```json\n{"a": {"b": "}"}}\n```') == '{"a": {"b": "}"}}' and R.json_in("none {") is None


def test_merge_subagents(spark):
    schema = "s string, k long, _msg_id string, thinking string, timestamp string"
    main = spark.createDataFrame([("s", 1, "a", None, "2"), ("s", 2, None, None, None), ("s", 3, "a", "", "3")], schema)
    extra = spark.createDataFrame([("s", 9, "a", "deep", "1"), ("s", 10, "b", None, "1"), ("s", 11, "b", None, "0"), ("s", 12, None, None, "5")], schema)
    got = [(r["k"], r["thinking"]) for r in E.merge_subagents(main, extra, ["s"], ["k"]).orderBy("position").collect()]
    assert got == [(10, None), (1, "deep"), (3, "deep"), (12, None), (2, None)]


def test_trials_and_job(spark, tmp_path):
    for trial, parts in {"t1__x": {"verifier/reward.json": {"reward": 0.5}, "result.json": {"task_name": "org/c1", "agent_result": {"cost_usd": 0.2, "n_input_tokens": 10, "n_cache_tokens": 4}}},
                         "t2__y": {"verifier/reward.json": {"reward": 1.0, "unjudged": True}}, "t3__z": {"exception.txt": "boom"}, "t4__q": {"result.json": {}}}.items():
        for name, body in parts.items():
            target = tmp_path / trial / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(json.dumps(body) if name.endswith(".json") else body)
    doc = lambda name: files.documents(spark, str(tmp_path), name)
    rows = files.trials(doc("reward.json"), doc("result.json"), doc("exception.txt"))
    got = {r["case_id"]: (r["reward"], r["errored"], r["cost_usd"], r["fresh_tokens"]) for r in rows.collect()}
    assert got == {"c1": (0.5, False, 0.2, 6), "t2": (None, False, None, None), "t3": (None, True, None, None)}
    whole = files.job(rows).first()
    assert (whole["trials"], whole["mean_reward"], whole["errors"]) == (3, 0.5, 1)


def test_runs(spark):
    calls = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, None), ("s", 4, None)], "s string, k long, tool_use_id string")
    assert sorted(r["k"] for r in U.denials(calls, ["s"], "k").collect()) == [1, 3, 4]
    folders = spark.createDataFrame([("case-1",), ("case-10-x",), ("b-1",), ("b-2",)], "folder string")
    cases = spark.createDataFrame([("case-1",), ("case-10",), ("b",), ("z",)], "case_id string")
    assert {r["case_id"]: r["folder"] for r in U.case_folders(cases, folders).collect()} == {"case-1": "case-1", "case-10": "case-10-x", "b": None, "z": None}
    named = spark.createDataFrame([("RFE-1-a.md",), ("RFE-1-b.md",), ("x.md",)], "name string")
    assert sorted(r["group"] for r in U.file_groups(named, 2).collect()) == ["RFE-1", "RFE-1", "x.md"]
    tags = spark.createDataFrame([({"a": "1", "id": "x"}, {"a": "2", "id": "y", "b": "3"})], "x map<string,string>, y map<string,string>")
    assert tags.select(U.overlay(F.col("x"), F.col("y"), "id").alias("m")).first()["m"] == {"a": "2", "id": "x", "b": "3"}
    keys = spark.createDataFrame([("p/c1/a.txt",), ("p/c1/b.txt",), ("p/top.txt",), ("p/c2/",)], "key string")
    assert {r["case_id"]: r["keys"] for r in files.object_cases(keys, "p/").collect()} == {"c1": ["p/c1/a.txt", "p/c1/b.txt"]}


def test_diff_lines_go_on_over_blocks_of_ids(spark, tmp_path):
    from lumenloom.plans import reports

    rows = [(998, "s", "a\nb"), (999, "t", "x"), (1001, "s", "a\nc"), (1002, "s", None), (5000, "s", "a"), (5001, "t", "x"), (7000, None, "n"), (9000, None, "n\nm")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["added"], r["deleted"]) for r in reports.diff_lines(spark, str(tmp_path)).collect()}
    assert got == {998: (2, 0), 999: (1, 0), 1001: (1, 1), 1002: (0, 2), 5000: (1, 0), 5001: (0, 0), 7000: (1, 0), 9000: (1, 0)}
