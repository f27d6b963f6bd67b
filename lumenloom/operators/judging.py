"""Judge results: bounds, sample reduction, aggregates, rewards, thresholds, pairwise comparison.

A judge value is a tagged union: value_kind (bool, num, str), value_bool, value_num, value_str, error. Bools
never become numbers on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.formula import compile_formula
from lumenloom.functions.scalars import normalise


def tagged(kind: str, value: Column, error: Column | None = None) -> list[Column]:
    """Columns of the union for a value of one kind."""
    missing = lambda t: F.lit(None).cast(t)
    return [
        F.when(value.isNotNull(), kind).alias("value_kind"),
        (value if kind == "bool" else missing("boolean")).alias("value_bool"),
        (value.cast("double") if kind == "num" else missing("double")).alias("value_num"),
        (value if kind == "str" else missing("string")).alias("value_str"),
        (error if error is not None else missing("string")).alias("error"),
    ]


def enforce_bounds(results: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """A number that is not finite or off its declared scale becomes an error; others pass."""
    v = F.col("value_num")
    off = F.isnan(v) | v.isin(float("inf"), float("-inf")) | ~v.between(F.coalesce(low, v), F.coalesce(high, v))
    wrong = F.coalesce(off & (F.col("value_kind") == "num"), F.lit(False))
    return (
        results.withColumn("_wrong", wrong)
        .withColumn("error", F.when(F.col("_wrong"), "out of bounds").otherwise(F.col("error")))
        .withColumn("value_num", F.when(~F.col("_wrong"), v))
        .withColumn("value_kind", F.when(~F.col("_wrong"), F.col("value_kind")))
        .drop("_wrong")
    )


def judge_condition(results: DataFrame, expression: str, columns: dict[str, Column]) -> DataFrame:
    """run, skip or error for each row: a false condition skips, one that cannot be computed is an error."""
    held = compile_formula(expression, columns)
    return results.withColumn("condition", F.when(held, "run").when(~held, "skip").otherwise("error"))


def judge_aggregate(results: DataFrame, *keys: str) -> DataFrame:
    """mean, pass_rate, scored_cases and errored_cases of each judge.

    All bools: mean = pass_rate = share of true. All numbers: mean only. Mixed: neither.
    """
    kind = F.col("value_kind")
    grouped = results.groupBy(*(keys or ("judge",))).agg(
        F.count(kind).alias("scored_cases"),
        F.count_if(kind.isNull() & F.col("error").isNotNull()).alias("errored_cases"),
        F.count_if(kind == "bool").alias("_b"),
        F.count_if(kind == "num").alias("_n"),
        F.avg(F.col("value_bool").cast("int")).alias("_rate"),
        F.avg("value_num").alias("_mean"),
    )
    all_bool = (F.col("_b") == F.col("scored_cases")) & (F.col("_b") > 0)
    all_num = (F.col("_n") == F.col("scored_cases")) & (F.col("_n") > 0)
    return grouped.select(
        *(keys or ("judge",)),
        F.when(all_bool, F.col("_rate")).when(all_num, F.col("_mean")).alias("mean"),
        F.when(all_bool, F.col("_rate")).alias("pass_rate"),
        "scored_cases",
        "errored_cases",
    )


def reduce_samples(samples: DataFrame, *keys: str, order: str) -> DataFrame:
    """One value for repeated samples: strict majority if all are bools, lower median if all are numbers, else the first.

    Where every sample failed the row has no value and the first error. stable: none failed and all agree.
    """
    v, kind = F.col("value_num"), F.col("value_kind")
    there = kind.isNotNull()
    first = F.min_by(F.when(there, F.struct("value_kind", "value_bool", "value_num", "value_str")), F.when(there, F.col(order)))
    text = F.coalesce(F.col("value_str"), v.cast("string"), F.col("value_bool").cast("string"))
    grouped = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count(kind).alias("_there"),
        F.count_if(~there & F.col("error").isNotNull()).alias("errors"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("_error"),
        F.min(kind).alias("_least"),
        F.max(kind).alias("_most"),
        F.count_if("value_bool").alias("passes"),
        F.expr("percentile_disc(0.5) within group (order by value_num)").alias("_median"),
        first.alias("_first"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
        F.round(F.avg(v), 2).alias("mean"),
        (F.min(F.when(there, text)) == F.max(F.when(there, text))).alias("_agree"),
    )
    one = F.col("_least") == F.col("_most")
    flags, numbers = one & (F.col("_least") == "bool"), one & (F.col("_least") == "num")
    return grouped.select(
        *keys,
        "samples",
        "errors",
        F.when(one, F.col("_least")).otherwise(F.col("_first.value_kind")).alias("value_kind"),
        F.when(flags, F.col("passes") * 2 > F.col("_there")).when(~numbers, F.col("_first.value_bool")).alias("value_bool"),
        F.when(numbers, F.col("_median")).when(~flags, F.col("_first.value_num")).alias("value_num"),
        F.col("_first.value_str").alias("value_str"),
        F.when(F.col("_there") == 0, F.coalesce("_error", F.lit("all samples failed"))).alias("error"),
        F.when(numbers, F.col("lowest")).alias("lowest"),
        F.when(numbers, F.col("highest")).alias("highest"),
        F.when(numbers, F.col("mean")).alias("mean"),
        F.coalesce((F.col("errors") == 0) & F.col("_agree"), F.lit(False)).alias("stable"),
    )


def stability(reduced: DataFrame, *keys: str) -> DataFrame:
    """Stable among sampled cases."""
    return reduced.groupBy(*keys).agg(
        F.count_if("stable").alias("stable_cases"), F.count("*").alias("total_cases"), F.max("samples").alias("samples")
    )


def scale_of(ranges: dict[str, tuple[float, float]] | None, low: float, high: float) -> tuple[Column, Column]:
    """Scale of the judge of a row: its own where it declares one, else the common one."""
    own = (ranges or {}).items()
    pick = lambda k, common: F.coalesce(*[F.when(F.col("judge") == j, float(r[k])) for j, r in own], F.lit(float(common)))
    return pick(0, low), pick(1, high)


def compose_reward(results: DataFrame, *keys: str, low: float = 1.0, high: float = 5.0, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Default reward: 0 if a bool is false, else the mean of the normalised numbers, else 0 after errors, else 1.

    ranges: scales of judges that declare one; the others are measured on [low, high].
    """
    low_, high_ = scale_of(ranges, low, high)
    return (
        results.groupBy(*keys)
        .agg(
            F.coalesce(F.bool_and("value_bool"), F.lit(True)).alias("_gate"),
            F.avg(normalise(F.col("value_num"), low_, high_)).alias("_mean"),
            F.coalesce(F.bool_or(F.col("value_kind").isNull() & F.col("error").isNotNull()), F.lit(False)).alias("_failed"),
        )
        .select(*keys, F.when(~F.col("_gate"), 0.0).when(F.col("_mean").isNotNull(), F.col("_mean")).when(F.col("_failed"), 0.0).otherwise(1.0).alias("reward"))
    )


def judge_value(low: Column | float, high: Column | float, raw: list[str] | tuple[str, ...] = ()) -> Column:
    """What a reward sees of a row: a bool as 0 or 1, a number on its scale; of raw judges the number itself within [0, 1]."""
    number = F.col("value_num")
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)) if raw else None
    scaled = normalise(number, low, high)
    return F.when(F.col("value_kind") == "bool", F.col("value_bool").cast("double")).otherwise(F.when(F.col("judge").isin(*raw), kept).otherwise(scaled) if raw else scaled)


def metric_map(results: DataFrame, *keys: str) -> DataFrame:
    """Map of judge to number for each case, bools as 0 and 1; other values stay out."""
    value = F.coalesce(F.col("value_num"), F.col("value_bool").cast("double"))
    found = results.select(*keys, F.struct("judge", value.alias("v")).alias("e")).groupBy(*keys)
    return found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("e.v").isNotNull(), F.col("e"))))).alias("metrics"))


def configured_reward(
    results: DataFrame, *keys: str, judge: str | None = None, weights: dict[str, float] | None = None, formula: str | None = None, gate: bool = True,
    low: float = 1.0, high: float = 5.0, ranges: dict[str, tuple[float, float]] | None = None, raw: tuple[str, ...] = (), normalise_judge: bool = False,
) -> DataFrame:
    """The reward a configuration asks for: one judge, weights, or a formula over judges by name; within [0, 1].

    With gate a false bool makes it 0. A single judge counts as it is unless normalise_judge is set; raw judges
    count as they are. A judge that is missing makes the single reward and a formula that reads it 0, and
    leaves its weight out.
    """
    from lumenloom.functions.formula import names

    low_, high_ = scale_of(ranges, low, high)
    gated = F.coalesce(F.bool_and("value_bool"), F.lit(True)).alias("_gate")
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))))
    pick = lambda name, value: F.max(F.when(F.col("judge") == name, value))
    if judge is not None:
        rows = results.groupBy(*keys).agg(gated, pick(judge, judge_value(low_, high_, () if normalise_judge else (judge,))).alias("_v"))
        value = F.col("_v")
    elif weights is not None:
        weight = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("judge") == j, float(w)) for j, w in weights.items()])
        seen = judge_value(low_, high_, raw)
        there = weight.isNotNull() & seen.isNotNull()
        rows = results.groupBy(*keys).agg(gated, F.sum(F.when(there, weight)).alias("_w"), F.sum(F.when(there, weight * seen)).alias("_s"))
        value = F.when(F.col("_w") > 0, F.col("_s") / F.col("_w"))
    else:
        read = names(formula)
        rows = results.groupBy(*keys).agg(gated, *[pick(j, judge_value(low_, high_, raw)).alias(f"_j{k}") for k, j in enumerate(read)])
        value = compile_formula(formula, {j: F.col(f"_j{k}") for k, j in enumerate(read)}).cast("double")
    return rows.select(*keys, (F.when(~F.col("_gate"), 0.0).otherwise(clipped(value)) if gate else clipped(value)).alias("reward"))


def weighted_reward(results: DataFrame, weights: dict[str, float], *keys: str, low: float, high: float, gate: bool = True) -> DataFrame:
    """Sum of weight times value over the judges that are there, divided by their weights; a false bool gates."""
    return configured_reward(results, *keys, weights=weights, low=low, high=high, gate=gate)


def never_passed(results: DataFrame, *keys: str) -> DataFrame:
    """failed_every_case of each judge: no bool was true; where there is no bool, nothing was scored and something failed."""
    flags = F.count("value_bool")
    return results.groupBy(*(keys or ("judge",))).agg(
        F.when(flags > 0, F.count_if("value_bool") == 0)
        .otherwise((F.count("value_kind") == 0) & (F.count_if(F.col("value_kind").isNull() & F.col("error").isNotNull()) > 0))
        .alias("failed_every_case")
    )


def unavailable_reason(errored: Column, metric: str, kind: str) -> Column:
    """Why a metric under a threshold is missing: errors are named before skipping."""
    failed = F.concat(F.lit(f"{metric} unavailable: judge errored on "), errored.cast("string"), F.when(errored == 1, " case").otherwise(" cases"))
    return F.when(F.coalesce(errored, F.lit(0)) > 0, failed).otherwise(f"{metric} unavailable: judge skipped for all cases or not {kind}")


def without_model_calls(judges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Judges (name, judge_type, builtin) that call no model: neither llm nor agent, nor a builtin of kind llm or unknown.

    kinds: (builtin, kind) of the registry.
    """
    known = judges.join(kinds, "builtin", "left")
    calls = F.col("judge_type").isin("llm", "agent") | (F.col("judge_type") == "builtin") & F.coalesce(F.col("kind") == "llm", F.lit(True))
    return known.filter(~F.coalesce(calls, F.lit(False))).select(*judges.columns)


def formula_reward(wide: DataFrame, formula: str, judges: list[str], gate: Column | None = None) -> Column:
    """Reward of a formula over pivoted judge columns, within [0, 1]; what cannot be computed is 0."""
    value = compile_formula(formula, {j: F.col(j).cast("double") for j in judges})
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))))
    return kept if gate is None else F.when(~F.coalesce(gate, F.lit(True)), 0.0).otherwise(kept)


def composite(results: DataFrame, *keys: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Composite: 0 behind a failing gate, else the weighted mean of clamped numbers (1 if none) times the share of
    passing bools that are no gates. Columns gate (boolean) and weight belong to the rows."""
    number = F.when(F.col("value_kind") == "num", normalise(F.col("value_num"), low, high))
    flag = F.when((F.col("value_kind") == "bool") & ~F.col("gate"), F.col("value_bool").cast("double"))
    agg = results.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(F.col("gate") & (F.col("value_kind") == "bool"), F.col("value_bool"))), F.lit(True)).alias("_gate"),
        F.coalesce(F.try_divide(F.sum(number * F.col("weight")), F.sum(F.when(number.isNotNull(), F.col("weight")))), F.lit(1.0)).alias("_mean"),
        F.coalesce(F.avg(flag), F.lit(1.0)).alias("_share"),
    )
    return agg.select(*keys, F.when(~F.col("_gate"), 0.0).otherwise(F.col("_mean") * F.col("_share")).alias("composite"))


def replications(scores: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, std (0 for one value), min, max and n of repeated scores."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
    )


def regressions(current: DataFrame, thresholds: DataFrame, baseline: DataFrame | None = None, drop: float = 0.5) -> DataFrame:
    """Breaches (judge, rule, bound, value) of thresholds; a metric that is missing under a threshold is one.

    current: judge_aggregate, with win_rate where there is one. Error rate is errored / (errored + scored), 0
    of none. Against a baseline, mean and pass_rate must not fall by more than drop. Judges without current
    results, and for the baseline those without a threshold, are not checked.
    """
    rate = F.coalesce(F.try_divide(F.col("errored_cases"), F.col("errored_cases") + F.col("scored_cases")), F.lit(0.0))
    values = F.create_map(
        F.lit("min_mean"), F.col("mean"), F.lit("min_pass_rate"), F.col("pass_rate"), F.lit("max_error_rate"), rate,
        F.lit("min_win_rate"), F.col("win_rate") if "win_rate" in current.columns else F.lit(None).cast("double"),
    )
    met = current.join(thresholds, "judge").withColumn("value", values[F.col("rule")])
    low = F.when(F.col("rule").startswith("max"), F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    found = met.filter(F.col("value").isNull() | low).select("judge", "rule", "bound", "value")
    if baseline is None:
        return found
    pairs = current.join(thresholds.select("judge").distinct(), "judge", "left_semi").alias("c").join(baseline.alias("b"), "judge")
    falls = pairs.select(
        "judge",
        F.inline(
            F.array(*[
                F.struct(F.lit(f"baseline_{m}").alias("rule"), (F.col(f"b.{m}") - drop).alias("bound"), F.col(f"c.{m}").alias("value"))
                for m in ("mean", "pass_rate")
            ])
        ),
    ).filter("value < bound")
    return found.unionByName(falls)


def winner(ab: Column, ba: Column) -> Column:
    """A if it wins in both orders, B likewise, error if an order has none, else tie."""
    return (
        F.when(ab.isNull() | ba.isNull(), "error").when((ab == "A") & (ba == "B"), "A").when((ab == "B") & (ba == "A"), "B").otherwise("tie")
    )


def pairwise_tally(cases: DataFrame, *keys: str) -> DataFrame:
    w = F.col("winner")
    return cases.groupBy(*keys).agg(
        F.count("*").alias("cases_compared"),
        F.count_if(w == "A").alias("wins_a"),
        F.count_if(w == "B").alias("wins_b"),
        F.count_if(w == "tie").alias("ties"),
        F.count_if(w == "error").alias("errors"),
    )


def pairwise_stability(runs: DataFrame, case: str, run: str) -> DataFrame:
    """For each case of repeated comparisons: stable, and the majority (of equals the one seen first)."""
    votes = runs.groupBy(case, "winner").agg(F.count("*").alias("n"), F.min(run).alias("seen"))
    return votes.groupBy(case).agg(
        (F.count("*") == 1).alias("stable"), F.min_by("winner", F.struct(-F.col("n"), F.col("seen"), F.col("winner"))).alias("majority"), F.sum("n").alias("runs")
    )


def agreement(runs: DataFrame, case: str, run: str) -> DataFrame:
    """One row for repeated comparisons: runs, cases of the first run, stable ones, their share, and the counts of each run in order."""
    first = runs.agg(F.min(run).alias("_first"))
    cases = runs.join(first, F.col(run) == F.col("_first")).select(case).distinct()
    stable = pairwise_stability(runs.join(cases, case, "left_semi"), case, run).agg(F.count("*").alias("total_cases"), F.count_if("stable").alias("stable_cases"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(run, c))), lambda x: x[c])
    tally = pairwise_tally(runs, run).agg(
        F.count("*").alias("runs"), in_order("wins_a").alias("wins_a_counts"), in_order("wins_b").alias("wins_b_counts"), in_order("ties").alias("tie_counts")
    )
    # both sides have one row
    return tally.crossJoin(F.broadcast(stable)).withColumn("agreement_rate", F.coalesce(F.try_divide("stable_cases", "total_cases"), F.lit(0.0)))


def frontier(conditions: DataFrame, cost: str, quality: str) -> DataFrame:
    """conditions with on_frontier: no other costs no more and is as good, with one of the two better.

    Rows are ordered by cost within a bounded table of conditions; ties survive. One sort and a running
    maximum instead of comparing all pairs.
    """
    upto = Window.orderBy(cost).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct(F.col(quality).alias("q"), (-F.col(cost)).alias("c"))).over(upto)
    on = (F.col(quality) == F.col("_best.q")) & (F.col(cost) == -F.col("_best.c"))
    return conditions.withColumn("_best", best).withColumn("on_frontier", on).drop("_best")
