"""Comparison of runs and models: accessors, tables by model and case, orders, best and worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_model(has_result: Column, model: Column, run_id: Column, name: Column) -> Column:
    """Model of a run: that of its result, else the part of its id from the word claude on, else its name."""
    known = F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown"))
    spelled = F.nullif(F.regexp_extract(run_id, r"(?:^|-)(claude(?:-.*)?)$", 1), F.lit(""))
    return F.when(has_result, known).otherwise(F.coalesce(spelled, F.nullif(name, F.lit("")), F.lit("unknown")))


#: Where a metric of a run stands: in its result, or in the metrics of its summary.
METRICS = {
    "cost_usd": ("result", "$.cost_usd"),
    "num_turns": ("result", "$.num_turns"),
    "wall_clock_s": ("result", "$.wall_clock_s"),
    "output_tokens": ("result", "$.token_usage.output"),
    "cache_hit_rate": ("summary", "$.run_metrics.cache_hit_rate"),
    "cost_per_turn": ("summary", "$.run_metrics.cost_per_turn_usd"),
    "output_tokens_per_turn": ("summary", "$.run_metrics.output_tokens_per_turn"),
}


def metric(name: str, result: Column, summary: Column) -> Column:
    """A metric of a run out of its two documents; an unknown name is null."""
    if name not in METRICS:
        return F.lit(None).cast("double")
    where, path = METRICS[name]
    return F.try_variant_get(result if where == "result" else summary, path, "double")


def judge_mean(mean: Column, pass_rate: Column) -> Column:
    return F.coalesce(mean, pass_rate)


def judge_names(judged: DataFrame) -> DataFrame:
    """Names of all judges, sorted, and whether any run gives them a pass rate."""
    return judged.groupBy("judge").agg(F.bool_or(F.col("pass_rate").isNotNull()).alias("is_pass_rate")).orderBy("judge")


def case_names(results: DataFrame) -> DataFrame:
    return results.select("case_id").distinct().orderBy("case_id")


def by_model(runs: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """Long table (model, metric, avg, min, max, count) over the runs of each model, nulls left out."""
    long = runs.unpivot([model], metrics, "metric", "v")
    return long.groupBy(model, "metric").agg(F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count"))


def model_order(judged: DataFrame, model: str, primary: str) -> DataFrame:
    """Models with their place by the mean of the primary judge, missing means as 0, names break ties."""
    means = judged.groupBy(model).agg(F.coalesce(F.avg(F.when(F.col("judge") == primary, judge_mean(F.col("mean"), F.col("pass_rate")))), F.lit(0.0)).alias("primary_mean"))
    # a table as long as the list of models
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("primary_mean"), model)))


def card_judges(means: DataFrame, most: int = 4) -> DataFrame:
    """The judges whose means by model differ most, names break ties: a listing, the limit is the feature."""
    spread = means.filter("mean is not null").groupBy("judge").agg((F.max("mean") - F.min("mean")).alias("spread"))
    return spread.orderBy(F.desc("spread"), "judge").limit(most)


def case_differences(results: DataFrame, model: str) -> DataFrame:
    """Mean score (judge, case_id, model, score) of every judge and case on which the models differ."""
    value = F.coalesce(F.col("value_num"), F.col("value_bool").cast("double"))
    scores = results.filter(value.isNotNull()).groupBy("judge", "case_id", model).agg(F.avg(value).alias("score"))
    vary = scores.groupBy("judge", "case_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi")).filter("_lo < _hi")
    return scores.join(vary.select("judge", "case_id"), ["judge", "case_id"], "left_semi")


def best_and_worst(rows: DataFrame, scope: list[str], value: str, order: str, higher_is_better: bool = True) -> DataFrame:
    """For each scope the first place of the best and of the worst value; null with fewer than two values or all equal."""
    there = rows.filter(F.col(value).isNotNull())
    v, at = F.col(value), F.col(order)
    agg = there.groupBy(*scope).agg(
        F.count("*").alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.min_by(at, F.struct(-v, at)).alias("_high"), F.min_by(at, F.struct(v, at)).alias("_low")
    )
    differ = (F.col("_n") > 1) & (F.col("_lo") < F.col("_hi"))
    best, worst = ("_high", "_low") if higher_is_better else ("_low", "_high")
    return agg.select(*scope, F.when(differ, F.col(best)).alias("best"), F.when(differ, F.col(worst)).alias("worst"))


def scoring_table(current: DataFrame, thresholds: DataFrame, breaches: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Judges with their thresholds, the means of a baseline, and status: breach, pass, or none without a threshold."""
    ruled = thresholds.groupBy("judge").agg(F.count("*").alias("rules"))
    broken = breaches.groupBy("judge").agg(F.array_sort(F.collect_set("rule")).alias("broken"))
    out = current.join(ruled, "judge", "left").join(broken, "judge", "left")
    out = out.withColumn("status", F.when(F.col("broken").isNotNull(), "breach").when(F.col("rules").isNotNull(), "pass").otherwise("none"))
    if baseline is None:
        return out
    return out.join(baseline.select("judge", F.col("mean").alias("baseline_mean")), "judge", "left").withColumn("delta", F.col("mean") - F.col("baseline_mean"))


def cases_by_prefix(files: DataFrame, cases: DataFrame, pattern: str, slot: str = "{case}") -> DataFrame:
    """Pairs (case_id, name) of files whose name begins with the pattern filled with a case; a short case may begin a longer one.

    All prefixes of a file name meet the filled patterns by equality, so no pair is compared in vain.
    """
    filled = cases.select("case_id", F.replace(F.lit(pattern), F.lit(slot), F.col("case_id")).alias("_p"))
    cut = files.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.left(F.col("name"), k))).alias("_p")).filter("name != ''")
    return cut.join(filled, "_p").select("case_id", "name")
