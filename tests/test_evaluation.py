"""Judging, rewards, statistics and scalars on literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import formula, shell
from lumenloom.functions import verdicts as V
from lumenloom.functions import scalars as S
from lumenloom.operators import judging as J
from lumenloom.operators import statistics as A

RESULT = "case_id string, judge string, value_kind string, value_bool boolean, value_num double, value_str string, error string"


def results(spark, rows):
    def union(v):
        if isinstance(v, bool):
            return ("bool", v, None, None, None)
        if isinstance(v, (int, float)):
            return ("num", None, float(v), None, None)
        if isinstance(v, str) and v.startswith("!"):
            return (None, None, None, None, v)
        return (None,) * 5 if v is None else ("str", None, None, v, None)

    return spark.createDataFrame([(c, j, *union(v)) for c, j, v in rows], RESULT)


def test_compose_reward_rules(spark):
    rows = [
        ("gate", "a", False), ("gate", "b", 5), ("mean", "a", True), ("mean", "b", 5), ("mean", "c", 1), ("off", "a", 9), ("failed", "a", "!no"),
        ("failed", "b", True), ("skipped", "a", None), ("text", "a", "fine"), ("mixed", "a", "!no"), ("mixed", "b", 3),
    ]
    got = {r["case_id"]: r["reward"] for r in J.compose_reward(results(spark, rows), "case_id").collect()}
    assert got == {"gate": 0.0, "mean": 0.5, "off": 1.0, "failed": 0.0, "skipped": 1.0, "text": 1.0, "mixed": 0.5}


def test_judge_aggregate_keeps_kinds_apart(spark):
    rows = [("1", "b", True), ("2", "b", False), ("3", "b", "!x"), ("1", "n", 2), ("2", "n", 4), ("3", "n", None), ("1", "m", True), ("2", "m", 3), ("1", "e", "!x")]
    got = {r["judge"]: tuple(r)[1:] for r in J.judge_aggregate(results(spark, rows)).collect()}
    assert got == {"b": (0.5, 0.5, 2, 1), "n": (3.0, None, 2, 0), "m": (None, None, 2, 0), "e": (None, None, 0, 1)}
    assert J.judge_aggregate(results(spark, [])).count() == 0


def test_bounds_and_samples(spark):
    rows = results(spark, [("1", "a", 7), ("2", "a", math.nan), ("3", "a", 3), ("4", "a", True)]).withColumn("low", F.lit(1.0)).withColumn("high", F.lit(5.0))
    got = {r["case_id"]: (r["value_num"], r["error"]) for r in J.enforce_bounds(rows).collect()}
    assert got["3"] == (3.0, None) and got["1"] == (None, "out of bounds") and got["2"][1] == "out of bounds" and got["4"] == (None, None)
    samples = results(spark, [("x", str(k), v) for k, v in enumerate([4, 1, 3, 2])] + [("y", str(k), v) for k, v in enumerate([True, False])] + [("z", "0", "b"), ("z", "1", "a")])
    got = {r["case_id"]: r for r in J.reduce_samples(samples, "case_id", order="judge").collect()}
    assert got["x"]["value_num"] == 2 and got["x"]["mean"] == 2.5 and not got["x"]["stable"]
    assert got["y"]["value_bool"] is False and got["z"]["value_str"] == "b"


def test_regressions(spark):
    now = spark.createDataFrame([("a", 2.0, None, 3, 0), ("b", 0.4, 0.4, 2, 2), ("c", None, None, 0, 0)], "judge string, mean double, pass_rate double, scored_cases long, errored_cases long")
    bounds = spark.createDataFrame([("a", "min_mean", 2.0), ("b", "max_error_rate", 0.4), ("b", "min_pass_rate", 0.5), ("c", "min_mean", 0.0), ("gone", "min_mean", 9.0)], "judge string, rule string, bound double")
    before = spark.createDataFrame([("a", 2.6, None), ("b", 0.5, 1.0)], "judge string, mean double, pass_rate double")
    got = {(r["judge"], r["rule"]) for r in J.regressions(now, bounds, before).collect()}
    assert got == {("b", "max_error_rate"), ("b", "min_pass_rate"), ("c", "min_mean"), ("a", "baseline_mean"), ("b", "baseline_pass_rate")}


def test_frontier_keeps_ties(spark):
    rows = [("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("d", 2.0, 3.0), ("e", 3.0, 2.0), ("f", 0.5, 0.1)]
    got = {r["c"]: r["on_frontier"] for r in J.frontier(spark.createDataFrame(rows, "c string, cost double, q double"), "cost", "q").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": True}


@pytest.mark.parametrize("bad", ["a ** 2", "__import__('os')", "a.b", "'x'", "2000000 + a", "x[0]", "lambda: 1", "open(a)", "+".join(["a"] * 150), "a; b"])
def test_formula_language_is_closed(bad):
    with pytest.raises(formula.FormulaError):
        formula.parse(bad)


def test_formula_values(spark):
    df = spark.createDataFrame([(4.0, 0.0), (1.0, 2.0)], "a double, b double")
    cols = {"a": F.col("a"), "b": F.col("b")}
    got = df.select(
        formula.compile_formula("a / b", cols).alias("x"), formula.compile_formula("max(a, b) if a > 2 and not b < 0 else -1", cols).alias("y"), J.formula_reward(df, "a / b", ["a", "b"]).alias("z")
    ).collect()
    assert [tuple(r) for r in got] == [(None, 4.0, 0.0), (0.5, -1.0, 0.5)]
    assert formula.names("min(a, q) + b") == ["a", "b", "q"]


def test_f_tail_against_published_tables():
    # upper 5 % and 1 % points
    for f, a, b, p in [(10.128, 1, 3, 0.05), (4.9646, 1, 10, 0.05), (3.4903, 3, 12, 0.05), (5.9525, 3, 12, 0.01), (2.2107, 8, 45, 0.0448)]:
        assert abs(A.f_tail(f, a, b) - p) < 2e-3
    assert abs(A.f_tail(3.947368, 1, 3) - 0.141122) < 1e-5


def test_repeated_measures_worked_value_and_degenerate(spark):
    data = {"x": [1, 0.75, 0.75, 0], "y": [0.75, 0.5, 0, 0]}
    rows = [(f"c{k}", level, float(v)) for level, vs in data.items() for k, v in enumerate(vs)]
    schema = "case_id string, context string, composite double"
    out = A.repeated_measures(spark.createDataFrame([*rows, ("only", "x", 1.0)], schema), "case_id", "context", "composite").first()
    assert abs(out["f"] - 3.947368) < 1e-5 and (out["df1"], out["df2"]) == (1, 3)
    shift = [(f"c{k}", level, float(k + (level == "y"))) for level in "xy" for k in range(4)]
    assert A.repeated_measures(spark.createDataFrame(shift, schema), "case_id", "context", "composite").first()["f"] is None


def test_mixed_effects_finds_the_effect(spark):
    r = random.Random(4)
    rows = [(f"c{k}", a, b, 1.0 * (a == "hi") + r.gauss(0, 0.3) + base) for k in range(25) for base in [r.gauss(0, 1)] for a in ("lo", "hi") for b in ("p", "q")]
    got = {x["factor"]: x["p_value"] for x in A.mixed_effects(spark.createDataFrame(rows, "case_id string, a string, b string, y double"), "case_id", ["a", "b"], "y").collect()}
    assert got["a"] < 1e-6 and got["b"] > 0.01


def test_design(spark):
    rows = A.full_factorial(spark, {"b": ["1", "2"], "a": ["x", "y", "z"]}).orderBy("position").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(a, b) for a in "xyz" for b in "12"] and len({r["condition_id"] for r in rows}) == 6
    cases = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "1"), ("n", "1"), ("n", "2")], "c string, d string")
    assert sorted(r["c"] for r in A.common_cases(cases, "c", "d").distinct().select("c").distinct().collect()) == ["k", "n"]


def test_shell():
    simple = {
        "cat a.txt 'b c.md' > out 2>&1": ["a.txt", "b c.md"], "sed -n '1,5p' src/x.py": ["src/x.py"], "sed -e p -f prog.sed y.txt": ["prog.sed", "y.txt"], "/usr/bin/head -n 5 f.md": ["f.md"],
        "tail -c 10 --quiet g.md": ["g.md"], "bash -lc 'cat inner.md'": ["inner.md"], "sh script.sh": [], "cat a.md|head": [], "cat a.md && ls": [], "cat $(ls)": [], "grep x f.md": [], "cat 2>/dev/null a.md": ["a.md"],
    }
    assert {c: shell.read_paths(c) for c in simple} == simple
    assert shell.scripts("python -u tools/run.py --x && ./bin/go.sh; ls") == ["tools/run.py", "./bin/go.sh"]
    assert shell.read_paths("cat 'broken") == []


def test_scalars(spark):
    row = spark.createDataFrame([("Ünï code!", 'x {"score": 4.5}', "a/b/c.md", None, "2026-03-01T10:00:00.5+02:00")], "a string, b string, c string, d string, e string").select(
        S.slug(F.col("a")).alias("slug"), V.score(F.col("b"), 1, 5, False).alias("score"), S.suffix_match(F.col("c"), F.lit("b/c.md")).alias("suffix"),
        S.truncate(F.lit("abcdef"), 3).alias("cut"), S.normalise(F.lit(None).cast("double"), 1.0, 5.0).alias("none"), S.tool_failed(F.col("d")).alias("failed"),
        S.iso_nanos(F.col("e")).alias("nanos"), V.flag_verdict(F.lit('{"passed": TRUE}')).alias("verdict"), S.count_words(F.lit("  a b\n c ")).alias("words"), S.number_text(F.lit(2.0)).alias("two"),
    ).first()
    assert (row["score"], row["suffix"], row["cut"], row["none"], row["failed"], row["verdict"], row["words"], row["two"]) == (4.5, True, "abc[truncated]", None, False, True, 3, "2")
    assert row["nanos"] == 1772352000500000000 and row["slug"] == "n-code"
