"""Scoring: cases by judges by samples, from a registry of judges, with conditions, bounds and errors as data.

A judge is a Column over the columns of a case, a check over them, or a call of a client that the caller gives
(a model, an agent): calls run in Arrow batches on the executors. No judge is called for a case whose
condition is false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import verdicts
from lumenloom.functions.formula import compile_formula
from lumenloom.functions.scalars import tool_failed
from lumenloom.operators import judging as J

#: Takes prompts, gives responses of the same number; an exception becomes an error of its sample.
Client = Callable[[str], str]


@dataclass(frozen=True)
class Judge:
    """kind: check or builtin (value: a Column builder), llm or agent (prompt: a Column builder, client: the call)."""

    name: str
    kind: str
    value: Callable[[], Column] | None = None
    prompt: Callable[[], Column] | None = None
    client: Client | None = None
    feedback: str | None = None
    scale: tuple[float, float] | None = None
    condition: str | None = None
    condition_columns: tuple[str, ...] = ()
    samples: int = 1
    step: str | None = None

    def calls_model(self) -> bool:
        return self.kind in ("llm", "agent")


@dataclass
class Registry:
    """Judges by name; a name may be given once."""

    judges: dict[str, Judge] = field(default_factory=dict)

    def add(self, judge: Judge) -> Registry:
        if judge.name in self.judges:
            raise ValueError(f"judge {judge.name} is there already")
        if judge.kind not in ("check", "builtin", "llm", "agent"):
            raise ValueError(f"unknown kind {judge.kind}")
        if judge.calls_model() != (judge.client is not None):
            raise ValueError(f"{judge.name}: llm and agent judges need a client, others have none")
        self.judges[judge.name] = judge
        return self

    def get(self, name: str) -> Judge:
        if name not in self.judges:
            raise KeyError(f"no judge {name}; known are {', '.join(sorted(self.judges))}")
        return self.judges[name]

    def deterministic(self) -> Registry:
        """Without the judges that call a model."""
        return Registry({n: j for n, j in self.judges.items() if not j.calls_model()})

    def ranges(self) -> dict[str, tuple[float, float]]:
        """Declared scales, those that are no range left out."""
        return {n: j.scale for n, j in self.judges.items() if j.scale and j.scale[0] < j.scale[1]}


def cost_budget(most: float, cost: str = "cost_usd") -> Callable[[], Column]:
    """Builtin: the cost is known and within the budget."""
    return lambda: F.coalesce(F.col(cost) <= most, F.lit(False))


def no_failed_tools(results: str = "tool_results") -> Callable[[], Column]:
    """Builtin: none of the results of tools (an array of texts) begins like an error."""
    return lambda: ~F.exists(F.coalesce(F.col(results), F.array().cast("array<string>")), tool_failed)


def step_record(cases: DataFrame, steps: DataFrame, case: str, step: str, scoped: list[str]) -> DataFrame:
    """Cases as one step saw them: the step's own columns where it has a record, even if they are null, else the case's."""
    one = steps.filter(F.col("step") == step).select(case, *[F.col(c).alias(f"_{c}") for c in scoped], F.lit(True).alias("_there"))
    both = cases.join(one, case, "left")
    return both.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in scoped}).drop("_there", *[f"_{c}" for c in scoped])


def _union(kind: str, value: Column, error: Column) -> list[Column]:
    none = lambda t: F.lit(None).cast(t)
    return [
        F.when(value.isNotNull(), kind).alias("value_kind"),
        (value.cast("boolean") if kind == "bool" else none("boolean")).alias("value_bool"),
        (value.cast("double") if kind == "num" else none("double")).alias("value_num"),
        none("string").alias("value_str"),
        F.when(value.isNull(), error).alias("error"),
    ]


def _asked(rows: DataFrame, judge: Judge, case: str) -> DataFrame:
    """Values of a judge that calls a client; each row is one sample."""
    client = judge.client

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, sample, prompt in batch.itertuples(index=False):
                try:
                    out.append((number, sample, client(prompt), None))
                except Exception as wrong:  # noqa: BLE001 - whatever a client raises is the error of its sample
                    out.append((number, sample, None, str(wrong) or type(wrong).__name__))
            yield pd.DataFrame(out, columns=[case, "sample", "response", "failed"])

    prompts = rows.select(F.col(case).cast("string").alias(case), "sample", judge.prompt().alias("prompt"))
    answers = prompts.mapInPandas(call, f"`{case}` string, sample int, response string, failed string")
    bounds = verdicts.numeric_bounds(judge.feedback, judge.scale)
    response = F.col("response")
    if judge.kind == "agent":
        value = verdicts.agent_value(verdicts.last_verdict(response), bounds is None, bool(bounds and bounds[2]))
    elif bounds is None:
        value = F.when(response.isNotNull(), verdicts.flag_verdict(response).cast("double"))
    else:
        value = verdicts.score(response, *bounds)
    kind = "bool" if bounds is None else "num"
    error = F.coalesce("failed", F.lit("no verdict in the response"))
    return answers.withColumn("_v", value).select(case, "sample", F.lit(judge.name).alias("judge"), F.lit(judge.kind).alias("judge_type"), *_union(kind, F.col("_v"), error))


def score_cases(cases: DataFrame, judges: Registry, case: str = "case_id", samples: int | None = None) -> DataFrame:
    """Long results (case, sample, judge, judge_type, value union, error) of all judges over all cases.

    Judges of columns run in one pass over the cases and once for each case; those that call a client run as
    often as they ask for, or as `samples` says. A false condition gives a row without value and error, one
    that cannot be computed an error; a number off its declared scale is an error. Cases are named by text.
    """
    named = cases.withColumn(case, F.col(case).cast("string"))
    plain, parts = [], []
    for judge in judges.judges.values():
        held = F.lit(True)
        if judge.condition:
            held = compile_formula(judge.condition, {c: F.col(c) for c in judge.condition_columns})
        wrong = F.when(held.isNull(), "condition error")
        low, high = judge.scale or (None, None)
        if judge.calls_model():
            n = samples if samples is not None else judge.samples
            rows = named.filter(held).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))
            asked = _asked(rows, judge, case)
            if judge.scale:
                asked = J.enforce_bounds(asked.withColumns({"low": F.lit(float(low)), "high": F.lit(float(high))})).drop("low", "high")
            kind = "bool" if judge.feedback == "bool" else "num"
            skipped = named.filter(~F.coalesce(held, F.lit(False)))
            parts += [asked, skipped.select(case, F.lit(0).alias("sample"), F.lit(judge.name).alias("judge"), F.lit(judge.kind).alias("judge_type"), *_union(kind, F.lit(None).cast("double"), wrong))]
            continue
        kind = "bool" if judge.feedback == "bool" else "num"
        value = F.when(held, judge.value())
        off = F.lit(False)
        if judge.scale and kind == "num":
            v = value.cast("double")
            off = F.coalesce(F.isnan(v) | v.isin(float("inf"), float("-inf")) | ~v.between(float(low), float(high)), F.lit(False))
        error = F.when(held.isNull(), "condition error").when(off, "out of bounds").when(held & value.isNull(), "no value")
        plain.append(F.struct(F.lit(judge.name).alias("judge"), F.lit(judge.kind).alias("judge_type"), *_union(kind, F.when(~off, value), error)))
    if plain:
        parts.insert(0, named.select(case, F.lit(0).alias("sample"), F.inline(F.array(*plain))))
    if not parts:
        raise ValueError("no judges")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reduced(results: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each case and judge: samples reduced; a judge that was skipped has neither value nor error."""
    out = J.reduce_samples(results, case, "judge", "judge_type", order="sample")
    return out.withColumn("error", F.when((F.col("errors") > 0) | F.col("value_kind").isNotNull(), F.col("error")))


def summary(results: DataFrame, case: str = "case_id") -> DataFrame:
    """mean, pass_rate, scored and errored cases of each judge, and how many of its sampled cases are stable."""
    per_case = reduced(results, case)
    scored = per_case.filter("value_kind is not null and samples > 1")
    steady = scored.groupBy("judge").agg(F.max("samples").alias("samples"), F.count_if("stable").alias("stable_cases"), F.count("*").alias("sampled_cases"))
    return J.judge_aggregate(per_case).join(steady, "judge", "left")
