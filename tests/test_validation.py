"""Case records, conditions of runs, trajectories, references, templates, differences."""

import json

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import texts as X
from lumenloom.operators import validation as W
from lumenloom.sources import cases as C


def _write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)


def test_case_records(spark, tmp_path):
    pytest.importorskip("yaml")
    _write(tmp_path / "cases", {
        "c1/annotations.yaml": "kind: hard\n", "c1/input.yaml": "prompt: do it\nnested:\n  deep: [1]\n", "c1/run_result.json": '{"cost_usd": null, "num_turns": 3}', "c1/out/a.md": "old", "c1/_modified/out/a.md": "new",
        "c1/events.jsonl": "{}", "c1/blob.bin": b"\xff\xfe\x00", "c1/steps/s1/x.txt": "x", "c2/task.json": '{"prompt": "other"}', "c2/gold.json": '{"a": 1}', "c3/broken.yaml": "a: [",
    })
    files = C.by_case(C.documents_of(C.texts(spark, str(tmp_path / "cases"))), "cases")
    run = F.parse_json(F.lit('{"cost_usd": 9.5, "exit_code": 1}'))
    got = {r["case_id"]: r for r in C.case_records(files, run).withColumn("input", F.to_json("input")).withColumn("annotations", F.to_json("annotations")).drop("hook_outputs").collect()}
    one, two = got["c1"], got["c2"]
    assert (one["cost_usd"], one["num_turns"], one["exit_code"], two["cost_usd"]) == (None, 3, 1, 9.5)
    assert one["files"] == {"out/a.md": "new", "blob.bin": "(binary content, 3 bytes)"} and one["events_file"] == "events.jsonl" and one["steps"] == ["s1"]
    assert json.loads(one["annotations"]) == {"kind": "hard"} and json.loads(two["input"]) == {"prompt": "other"} and got["c3"]["input"] is None
    value = lambda s: {r["case_id"]: r["value"] for r in C.field_of(files, s).collect()}
    assert value("input.yaml:nested.deep") == {"c1": "[1]"} and value("input.yaml:no.such") == {"c1": None} and value("out/a.md:__file__") == {"c1": "old"}


def test_conditions_of_runs(spark):
    doc = {"per_case": {"k": {"s": {"value": 5}, "g": {"value": True}}, "m": {"s": {"value": 3}, "g": {"value": False}}}}
    runs = spark.createDataFrame([(r, json.dumps(doc if r != "r4" else {})) for r in ("r1", "r2", "r3", "r4", "r5")], "run string, t string").select("run", F.parse_json("t").alias("doc"))
    levels = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b"), ("r4", "b"), ("r5", None)], "run string, model string")
    costs = spark.createDataFrame([("r1", 1.0), ("r2", 3.0), ("r3", None)], "run string, cost_usd double")
    rows, cost = C.conditions(runs, levels, ["model"], costs)
    assert sorted((r["model"], r["replication"], r["case_id"], r["composite"]) for r in rows.collect()) == [("a", 0, "k", 1.0), ("a", 0, "m", 0.0), ("a", 1, "k", 1.0), ("a", 1, "m", 0.0), ("b", 0, "k", 1.0), ("b", 0, "m", 0.0)]
    assert [r["cost"] for r in cost.collect()] == [2.0]


def test_trajectories_and_end_times(spark):
    doc = {"steps": [
        {"source": "user", "message": " hi ", "timestamp": "t0"}, {"source": "user", "message": " "}, {"source": "agent", "reasoning_content": "why", "tool_calls": [{"tool_call_id": "a", "arguments": {"x": 1}}, {"tool_call_id": "b", "arguments": "no"}]},
        {"source": "agent", "observation": {"results": [{"source_call_id": "a", "content": "y" * 9}, {"source_call_id": "a", "content": "z" * 9}, {"source_call_id": "b", "content": 3}]}}, "odd",
    ]}
    df = spark.createDataFrame([("t", json.dumps(doc)), ("u", "{}")], "k string, t string").select("k", F.parse_json("t").alias("doc"))
    assert [tuple(r) for r in C.user_steps(df, "k").collect()] == [("t", 0, "hi", "t0")] and [r["reasoning"] for r in C.reasoning_steps(df, "k").collect()] == ["why"]
    assert [tuple(r) for r in C.tool_data(df, "k", 4).collect()] == [("t", "a", '{"x":1}', "zzzz")]
    rows = [("s", 1, "tool_result", None, None, "u", "2026-01-01T00:00:05Z"), ("s", 0, "system", "task_notification", "completed", "u", "2026-01-01T00:00:01Z"), ("s", 2, "tool_result", None, None, "v", "2026-01-01T00:00:02Z")]
    ends = C.end_times(spark.createDataFrame(rows, "s string, position int, type string, subtype string, status string, tool_use_id string, timestamp string"), ["s"])
    assert {r["tool_use_id"]: r["ended"].second for r in ends.collect()} == {"u": 1, "v": 2}


def test_references(spark):
    texts = spark.createDataFrame([("a", "Use the /b skill, see `/c` and https://x.org/d skill, /a skill, `/b`, the /name skill.")], "name string, content string")
    got = {(r["target"], r["confidence"]) for r in W.skill_references(texts, "name", "content", [r"/([\w-]+) skill"], r"`/([\w-]+)`").collect()}
    assert got == {("b", "strong"), ("c", "weak")}
    skills = spark.createDataFrame([("a", "skills/a", "run scripts/go.py and scripts/no.sh, ../../../scripts/out.py")], "name string, folder string, content string")
    files = spark.createDataFrame([("skills/a/scripts/go.py",)], "path string")
    assert {tuple(r) for r in W.script_references(skills, files).collect()} == {("a", "scripts/go.py", True, "strong"), ("a", "scripts/no.sh", False, "strong"), ("a", "../../../scripts/out.py", False, "weak")}
    configs = spark.createDataFrame([("e", "p:a", "own"), ("e", "p:a", "own"), ("e", "gone", "own"), ("f", "gone", "cli"), ("g", "foo", "own")], "name string, skill string, runner_type string")
    assert {tuple(r) for r in W.config_references(configs, skills, "own").collect()} == {("e", "p:a", True), ("e", "gone", False)}


def test_templates_and_rules(spark):
    judges = spark.createDataFrame([("j", "{{ outputs.x }} {% for a, b in rows %}{{ a }}{{ b.c }}{% endfor %}{% set k = 1 %}{{ k }} {{ nope }}"), ("ok", "plain")], "name string, prompt string")
    assert [tuple(r) for r in W.undefined_variables(judges, ["rows"], ["outputs"]).collect()] == [("j", ["nope"])]
    rules = spark.createDataFrame([(0, "Bash(ls)", None, None), (1, None, "/x", ["Read", "Bash"]), (2, "Bash(ls)", None, None), (3, None, "", ["Read"])], "position int, rule string, path string, tools array<string>")
    assert {tuple(r) for r in W.permission_rules(rules, ["Read", "Write", "Edit"], True).collect()} == {(0, "Bash(ls)"), (1, "Read(/x)"), (1, "Edit(/x)")}
    row = spark.range(1).select(
        W.tool_patterns(F.lit("calls to webfetch and mcp__db__get*"), ["WebFetch", "Bash"]).alias("a"), W.tool_patterns(F.lit("some api"), ["Read"]).alias("b"), W.tool_patterns(F.lit("x"), ["Read"]).alias("c"),
        W.artifact_type(F.lit("g.dot"), {"*.dot": "graph", "g.txt": "text"}).alias("d"), W.front_matter_keys(F.lit("b: 1\na: 2\n  c: 3")).alias("e"),
        W.named_actions(F.parse_json(F.lit('{"num_turns": 0, "result": "Unknown command: /x y"}'))).alias("f"), W.named_actions(F.parse_json(F.lit('{"num_turns": 2, "result": "Unknown command: /x"}'))).alias("g"),
        W.moved_members(F.create_map(F.lit("p"), F.lit("1"), F.lit("category"), F.lit("2")), F.lit(None).cast("map<string,string>"), ["category"]).alias("h"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == (["WebFetch", "mcp__db__get*"], ["Bash"], ["*"], "graph", ["a", "b"], "/x", None)
    assert row["h"]["input"] == {"p": "1"} and row["h"]["annotations"] == {"category": "2"}


def test_texts(spark):
    assert X.fill("a {x}  {y?} b", {"x": 1}) == "a 1 b"
    with pytest.raises(X.MissingField):
        X.fill("{x}", {})
    row = spark.createDataFrame([("v", None)], "x string, y string").select(
        X.filled("a {x} {y?} b", {"x": F.col("x"), "y": F.col("y")}).alias("f"), X.cap_values(F.lit('{"a": "xxxxxxxx", "b": {"c": "yyyyyyyy"}, "d": 1}'), 5).alias("c"),
        X.user_text(F.parse_json(F.lit('[{"type": "text", "text": " a "}, {"type": "image"}, {"type": "text", "text": "b"}]'))).alias("u"), X.user_text(F.parse_json(F.lit('"  t "'))).alias("v"),
        X.output_blocks(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("o"), X.line_differences(F.lit("a\nb\nc"), F.lit("a\nx\nc")).alias("d"), X.extract_array(F.lit('so: ```json\n[{"k": 1}, {"k": 2}, {"k": ')).alias("j"),
    ).first()
    assert row["f"] == "a v b" and json.loads(row["c"])["_truncated"]["a"]["original_length"] == 8 and json.loads(row["c"])["b"]["c"] == "yyyyy[truncated]"
    assert (row["u"], row["v"], row["o"]) == ("a\n\nb", "t", "\n### a\n\n1\n\n### b\n\n2\n") and json.loads(row["j"]) == [{"k": 1}, {"k": 2}]
    assert [tuple(d) for d in row["d"]] == [("equal", "a", "a"), ("replace", "b", "x"), ("equal", "c", "c")]
    assert X.word_marks("a b", "a c") == ("a <del>b</del>", "a <ins>c</ins>") and X.json_array("none") is None and X.json_array("x [1] []") == [1]
