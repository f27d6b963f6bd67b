"""Scoring with a registry and clients, verdicts of free texts, formulas, samples with errors, events of all item types."""

import json

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import formula
from lumenloom.functions import scalars as S
from lumenloom.functions import verdicts as V
from lumenloom.operators import analysis, compare, scoring, trials
from lumenloom.operators import judging as J
from lumenloom.operators import reports as R
from lumenloom.operators import statistics as A
from lumenloom.operators import transcripts as E
from lumenloom.plans import checks

UNION = "case_id string, sample int, judge string, value_kind string, value_bool boolean, value_num double, value_str string, error string"


def _value(v):
    if isinstance(v, str) and v.startswith("!"):
        return None, None, None, None, v[1:]
    return ("bool", v, None, None, None) if isinstance(v, bool) else ("num", None, float(v), None, None) if isinstance(v, (int, float)) else ("str", None, None, v, None)


def _samples(spark, rows):
    return spark.createDataFrame([(c, s, "j", *_value(v)) for c, s, v in rows], UNION)


def test_samples_with_errors(spark):
    rows = [("a", 0, "!x"), ("a", 1, "!y"), ("b", 0, "!x"), ("b", 1, 3), ("c", 0, 2), ("c", 1, 2), ("d", 0, "z"), ("d", 1, True), ("e", 0, True), ("e", 1, True), ("f", 0, True), ("f", 1, False)]
    got = {r["case_id"]: r for r in J.reduce_samples(_samples(spark, rows), "case_id", order="sample").collect()}
    assert (got["a"]["value_kind"], got["a"]["error"], got["a"]["errors"], got["a"]["stable"]) == (None, "x", 2, False)
    assert (got["b"]["value_num"], got["b"]["stable"]) == (3.0, False) and (got["c"]["value_num"], got["c"]["stable"]) == (2.0, True)
    assert (got["d"]["value_kind"], got["d"]["value_str"], got["d"]["stable"]) == ("str", "z", False)
    assert (got["e"]["value_bool"], got["e"]["stable"]) == (True, True) and got["f"]["value_bool"] is False


@pytest.mark.parametrize(
    "text,want",
    [
        ("Overall rating: 2, see item 4", 2.0), ("7/10 files pass. 3", 3.0), ('{"score": "4", "rationale": "x"}', 4.0), ("score = 3.5", 4.0), ("**2**/5", 2.0), ("nothing", None), ("-1 or -7", None),
        ("```json\n{\"score\": 5}\n```", 5.0), ("", None), (None, None),
    ],
)
def test_scores(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(V.score(F.col("t"), 1.0, 5.0).alias("s")).first()
    assert row["s"] == want


def test_scales(spark):
    df = spark.createDataFrame([("it is -0.5 here",)], "t string")
    assert df.select(V.score(F.col("t"), -1.0, 1.0, False).alias("s")).first()["s"] == -0.5
    assert V.numeric_bounds("bool", (0, 1)) is None and V.numeric_bounds(None, (0, 2.5)) == (0.0, 2.5, False) and V.numeric_bounds("float", (0, 2)) == (0.0, 2.0, False) and V.numeric_bounds(None, None) == (1.0, 5.0, True)
    members = F.create_map(F.lit("preferred"), F.lit("A" * 60), F.lit("x"), F.lit("b" * 50), F.lit("y"), F.lit("c" * 70))
    assert df.select(V.reasoning_text(members).alias("r")).first()["r"] == "c" * 70
    assert df.select(V.first_value(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("2")), ["a", "b"]).alias("r")).first()["r"] == "2"


def test_formulas_follow_the_language(spark):
    df = spark.createDataFrame([(4.0, None, -7.0)], "a double, q double, n double")
    cols = {c: F.col(c) for c in df.columns}
    want = {
        "min(q, 1)": None, "max(a, 1)": 4.0, "gate = mean([a, 2])\ngate * 2": 6.0, "sum([a, 1, 2]) / len([a, 1])": 3.5, "n % 4": 1.0, "n // 2": -4.0, "round(a / 3, 2)": 1.33,
        "(a > 3) * 0.5": 0.5, "1 if a else 0": 1.0, "1 if q else 0": None, "a / 0": None, "abs(n) - 7": 0.0, "sum([])": 0.0,
    }
    row = df.select(*[formula.compile_formula(f, cols).cast("double").alias(f"c{k}") for k, f in enumerate(want)]).first()
    assert [row[k] for k in range(len(want))] == pytest.approx(list(want.values()))
    assert formula.names("gate = mean([a, b])\ngate * score") == ["a", "b", "score"]
    for bad in ("sqrt(a)", "clamp(a, 0, 1)", "x = 1", "_x = 1\n_x", "a.b = 1\na", "round(a, q)", "min(a)"):
        with pytest.raises(formula.FormulaError):
            formula.compile_formula(bad, cols)


def test_configured_rewards(spark):
    rows = [("1", 0, "g", True), ("1", 0, "s", 2), ("2", 0, "g", False), ("2", 0, "s", 2), ("3", 0, "g", True)]
    df = spark.createDataFrame([(c, s, j, *_value(v)) for c, s, j, v in rows], UNION)
    reward = lambda **kw: {r["case_id"]: r["reward"] for r in J.configured_reward(df, "case_id", **kw).collect()}
    assert reward(judge="s", ranges={"s": (0, 4)}, normalise_judge=True) == {"1": 0.5, "2": 0.0, "3": 0.0}
    assert reward(judge="s", gate=False) == {"1": 1.0, "2": 1.0, "3": 0.0}
    assert reward(weights={"g": 1, "s": 3}, ranges={"s": (0, 4)}) == {"1": 0.625, "2": 0.0, "3": 1.0}
    assert reward(formula="g * s", ranges={"s": (0, 4)}) == {"1": 0.5, "2": 0.0, "3": 0.0}
    assert {r["case_id"]: r["reward"] for r in J.compose_reward(df, "case_id", ranges={"s": (0, 2)}).collect()} == {"1": 1.0, "2": 0.0, "3": 1.0}


def test_scoring_with_clients_conditions_and_errors(spark):
    cases = spark.createDataFrame([(1, "good", 0.2), (2, "bad", 0.2), (3, "good", None), (4, "boom", 0.9)], "case_id int, text string, cost_usd double")

    def client(prompt):
        if prompt == "boom":
            raise RuntimeError("no answer")
        return json.dumps({"score": 5 if prompt == "good" else 9, "rationale": "r"})

    registry = scoring.Registry()
    registry.add(scoring.Judge("budget", "builtin", value=scoring.cost_budget(0.5), feedback="bool"))
    registry.add(scoring.Judge("model", "llm", prompt=lambda: F.col("text"), client=client, scale=(1, 5), samples=2, condition="cost_usd > 0", condition_columns=("cost_usd",)))
    with pytest.raises(ValueError):
        registry.add(scoring.Judge("budget", "check", value=lambda: F.lit(1)))
    results = scoring.score_cases(cases, registry)
    got = {(r["case_id"], r["judge"]): r for r in scoring.reduced(results).collect()}
    assert got["1", "model"]["value_num"] == 5 and got["1", "model"]["samples"] == 2 and got["2", "model"]["error"] == "out of bounds" and got["4", "model"]["error"] == "no answer"
    assert got["3", "model"]["error"] == "condition error" and got["3", "budget"]["value_bool"] is False and got["4", "budget"]["value_bool"] is False
    table = {r["judge"]: (r["scored_cases"], r["errored_cases"]) for r in scoring.summary(results).collect()}
    assert table == {"budget": (4, 0), "model": (1, 3)}
    assert set(registry.deterministic().judges) == {"budget"}
    assert scoring.score_cases(cases.limit(0), registry).count() == 0
    steps = spark.createDataFrame([(1, "s1", None), (2, "s2", 0.1)], "case_id int, step string, cost_usd double")
    assert {r["case_id"]: r["cost_usd"] for r in scoring.step_record(cases, steps, "case_id", "s1", ["cost_usd"]).collect()} == {1: None, 2: 0.2, 3: None, 4: 0.9}


def test_items_of_every_type(spark):
    items = [
        {"type": "agent_message", "id": "i1", "text": "hi"}, {"type": "reasoning", "text": 3, "summary": "why"}, {"type": "mystery", "id": "x"},
        {"type": "mcp_tool_call", "id": "i4", "server": "db", "tool": "get", "arguments": {"k": 1}, "error": {"m": "no"}},
        {"type": "mcp_tool_call", "id": "i5", "arguments": "raw", "result": "fine"}, {"type": "collab_tool_call", "id": "i6", "prompt": "do", "status": "failed"},
        {"type": "web_search", "id": "i7", "query": "q"}, {"type": "file_change", "id": "i8", "changes": [{"path": "a.py"}], "status": "done"}, {"type": "command_execution", "id": "i9", "command": "ls", "exit_code": True},
    ]
    rows = [(k, json.dumps({"type": "item.completed", "item": item, "timestamp": f"t{k}"})) for k, item in enumerate(items)]
    rows += [(20, json.dumps({"type": "turn.completed", "timestamp": "u1"})), (21, json.dumps({"type": "turn_completed", "timestamp": "u2"})), (22, json.dumps({"type": "item.completed", "item": 5}))]
    lines = spark.createDataFrame(rows, "line_id long, line string")
    got = {}
    for r in E.flat_events(lines).orderBy("line_id", "event_no").collect():
        tool = r["tools"][0] if r["tools"] else None
        got.setdefault(r["line_id"], []).append((r["type"], r["text"], r["thinking"], tool and tool["name"], tool and json.loads(tool["input_json"]), r["content"], r["is_error"], r["_msg_id"]))
    call = lambda name, given: ("assistant", "", None, name, given, None, None, None)
    back = lambda content, wrong: ("tool_result", None, None, None, None, content, wrong, None)
    assert got == {
        0: [("assistant", "hi", None, None, None, None, None, "i1")], 1: [("assistant", "", "why", None, None, None, None, None)],
        3: [call("mcp__db__get", {"k": 1}), back('{"m":"no"}', True)], 4: [call("mcp__mcp__tool", {"arguments": "raw"}), back("fine", False)],
        5: [call("collaboration", {"prompt": "do"}), back("failed", True)], 6: [call("WebSearch", {"query": "q"}), back("", False)],
        7: [call("Edit", {"changes": [{"path": "a.py"}], "file_path": "a.py"}), back("done", False)], 8: [call("Bash", {"command": "ls"}), back("", False)],
    }
    turn = E.turn_results(lines.withColumn("run_id", F.lit("r")), ["run_id"]).first()
    assert (turn["num_turns"], turn["timestamp"], turn["cost_usd"], turn["line_id"]) == (2, "u2", None, 21)


def test_usage_prefers_the_models_of_the_last_result(spark):
    rows = [
        {"type": "assistant", "message": {"id": "a", "model": "m", "usage": {"input_tokens": 7, "output_tokens": 1}}}, {"type": "assistant", "message": {"id": "b", "model": "<synthetic>"}},
        {"type": "result", "total_cost_usd": 0.5, "modelUsage": {"m": {"inputTokens": 3, "outputTokens": 4, "costUSD": 0.2}}}, {"type": "result", "modelUsage": {"m": {"inputTokens": 5}, "n": {"inputTokens": 6}}}, {"type": "result"},
    ]
    df = spark.createDataFrame([(k, "r", json.dumps(r)) for k, r in enumerate(rows)], "line_id long, run_id string, line string")
    u = E.usage(df, ["run_id"]).first()
    assert (u["input_tokens"], u["output_tokens"], u["num_turns"], u["models"], u["cost_usd"], set(u["by_model"])) == (11, 0, 2, ["m"], 0.5, {"m", "n"})
    plain = E.usage(df.filter("line_id < 2"), ["run_id"]).first()
    assert (plain["input_tokens"], plain["cost_usd"], plain["by_model"]) == (7, None, None)


def test_slugs_stay_unique_over_all_bases(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "b"), (5, "b")], "k int, name string")
    assert {r["k"]: r["slug"] for r in R.unique_slugs(rows, "name", "k").collect()} == {1: "a", 2: "a-2", 3: "a-2-2", 4: "b", 5: "b-2"}


def test_labels_and_texts(spark):
    df = spark.createDataFrame([("claude-test-4-5[1m]",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(S.short_model(F.col("m"))).collect()] == ["Test 4.5 [1M]", "other", None]
    one = spark.range(1)
    doc = F.try_parse_json(F.lit('{"a": true, "b": 2, "c": 2.5, "d": "3"}'))
    row = one.select(
        S.strict_number(doc, "$.a").alias("a"), S.strict_number(doc, "$.c").alias("c"), S.strict_int(doc, "$.b").alias("b"), S.strict_int(doc, "$.d").alias("d"),
        S.seconds_between(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T01:00:01+01:00")).alias("s"), S.is_denial(F.lit("User Denied it")).alias("deny"),
        S.text_of(F.lit(75.0), "time").alias("t"), S.text_of(F.lit(None).cast("double")).alias("n"), S.range_text(F.lit(2.0), F.lit(1.0), F.lit(3.0), F.lit(2)).alias("r"),
        S.tool_summary(F.lit("Read"), F.lit('{"file_path": "a", "offset": 3}')).alias("read"), S.tool_summary(F.lit("X"), F.lit('{"k": 1}')).alias("other"), S.unescaped(F.lit("a\\nb")).alias("u"),
        S.front_matter(F.lit("---\nk: 1\n---\nbody")).alias("f"), compare.run_model(F.lit(False), F.lit(None).cast("string"), F.lit("2026-claude-x-1"), F.lit("n")).alias("model"),
    ).first()
    assert (row["a"], row["c"], row["b"], row["d"], row["s"], row["deny"], row["t"], row["n"], row["r"]) == (None, 2.5, 2, 0, 1.0, True, "1 min", "--", "2.00 (1.00-3.00)")
    assert (row["read"], row["other"], row["u"], tuple(row["f"]), row["model"]) == ("a, offset=3", "k=1", "a\nb", ("k: 1", "body"), "claude-x-1")


def test_analysis_of_designs(spark):
    rows = [(f"c{k}", c, c[0], c[1], k + (c[0] == "y") + 0.1 * ((k * 7) % 5) * (c[1] == "q")) for k in range(8) for c in ("xp", "xq", "yp", "yq")] + [("lone", "xp", "x", "p", 1.0)]
    df = spark.createDataFrame(rows, "case_id string, condition_id string, a string, b string, composite double")
    two = analysis.analyse(df, ["a", "b"])
    assert two.method == "mixed effects" and [r["case_id"] for r in two.excluded.collect()] == ["lone"] and {r["factor"] for r in two.p_values().collect()} == {"a", "b"}
    assert {r["condition"] for r in two.per_case.collect()} == {"a=x, b=p", "a=x, b=q", "a=y, b=p", "a=y, b=q"} and two.design.first()["n_cases"] == 8
    one = analysis.analyse(df.filter("b = 'q'"), ["a", "b"])
    assert one.method == "repeated measures" and one.factors == ["a"]
    none = analysis.analyse(df.filter("condition_id = 'xp'"), ["a", "b"])
    assert none.method == "skipped" and none.test is None
    costs = spark.createDataFrame([("xp", 1.0), ("xq", 2.0), ("yp", 3.0)], "condition_id string, cost double")
    assert all(r["on_frontier"] for r in analysis.analyse(df, ["a", "b"], costs).summaries.collect())
    apart = spark.createDataFrame([("k", "1"), ("m", "2")], "c string, d string")
    assert A.common_cases(apart, "c", "d").count() == 2
    assert analysis.experiment_id({"b": [1], "a": ["x"]}).startswith("exp-a-b-") and analysis.estimated_runs(2, 3, 4, 0.5) == (24, 12.0)
    assert analysis.cell_run_id("d", {"model": "m/1", "z": 2, "a": "x"}, 1, 3) == "d-m_1-a-x-z-2-r2"


def test_trials_and_comparison(spark):
    steps = spark.createDataFrame(
        [("t", "s1", 0.5, False, None, 0.1, 2), ("t", "s2", None, True, None, None, None), ("t", "s3", None, False, None, 0.2, 1), ("u", "s1", 0.2, False, 0.9, None, None)],
        "trial string, step string, reward double, unjudged boolean, engine_reward double, cost_usd double, num_turns long",
    ).withColumns({"duration_s": F.lit(None).cast("double"), "tokens": F.lit(None).cast("long")})
    got = {r["trial"]: r for r in trials.step_rollup(steps, "trial", "step").collect()}
    assert (got["t"]["reward"], got["t"]["infra_error_steps"], got["t"]["unjudged_steps"], got["t"]["num_turns"]) == (0.5, ["s3"], ["s2"], 3)
    assert (got["u"]["reward"], got["u"]["cost_usd"], got["u"]["num_turns"]) == (0.9, None, None)
    files, cases = spark.createDataFrame([("RFE-1-a.md",), ("RFE-10.md",), ("x",)], "name string"), spark.createDataFrame([("1",), ("10",)], "case_id string")
    assert {tuple(r) for r in compare.cases_by_prefix(files, cases, "RFE-{case}").collect()} == {("1", "RFE-1-a.md"), ("1", "RFE-10.md"), ("10", "RFE-10.md")}


def test_every_query_has_its_sql():
    assert set(checks.QUERIES) - set(checks.ORACLES) == {"analysis_test"}
