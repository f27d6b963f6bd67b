"""Trials of a job: steps rolled up to trials, trials to a summary; usage of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators import judging as J


def step_rollup(steps: DataFrame, trial: str, step: str) -> DataFrame:
    """One row for each trial of several steps (reward, unjudged, engine_reward, cost_usd, num_turns, duration_s, tokens).

    The reward is the mean over steps that were verified; a reward that the engine wrote replaces it, that of
    the last step that has one. Steps without a reward are infrastructure errors unless they were never to be
    judged; neither counts as 0. Sums stay null until a step has a number.
    """
    verified = F.col("reward").isNotNull() & ~F.coalesce("unjudged", F.lit(False))
    names = lambda when: F.array_sort(F.collect_list(F.when(when, F.col(step))))
    unjudged = F.coalesce("unjudged", F.lit(False))
    return steps.groupBy(trial).agg(
        F.coalesce(F.max_by("engine_reward", F.when(F.col("engine_reward").isNotNull(), F.col(step))), F.avg(F.when(verified, F.col("reward")))).alias("reward"),
        F.count("*").alias("steps"),
        F.count_if(verified).alias("verified_steps"),
        names(~verified & ~unjudged).alias("infra_error_steps"),
        names(unjudged).alias("unjudged_steps"),
        F.sum("cost_usd").alias("cost_usd"),
        F.nullif(F.sum("num_turns"), F.lit(0)).alias("num_turns"),
        F.nullif(F.sum("duration_s"), F.lit(0.0)).alias("duration_s"),
        F.sum("tokens").alias("tokens"),
    )


def judge_summary(results: DataFrame) -> DataFrame:
    """mean and pass_rate of each judge over all trials, repeated ones too."""
    return J.judge_aggregate(results).select("judge", "mean", "pass_rate")


def per_case(results: DataFrame, order: str) -> DataFrame:
    """Results by case: of a case that was tried again, those of the last trial."""
    last = results.groupBy("case_id").agg(F.max(order).alias("_last"))
    return results.join(last, "case_id").filter(F.col(order) == F.col("_last")).drop("_last")


def overall(cases: DataFrame, *keys: str) -> DataFrame:
    """Exit code of largest magnitude, cost and turns of all cases, nil as null."""
    return cases.groupBy(*keys).agg(
        F.max_by("exit_code", F.abs("exit_code")).alias("exit_code"), F.nullif(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.nullif(F.sum("num_turns"), F.lit(0)).alias("num_turns")
    )


def average_reward(rewards: DataFrame, metrics: str, *keys: str) -> DataFrame:
    """Mean reward of the cases that have metrics; a case without any is not scored."""
    scored = F.size(metrics) > 0
    return rewards.groupBy(*keys).agg(F.avg(F.when(scored, F.col("reward"))).alias("mean_reward"), F.count_if(scored).alias("scored_cases"))


def newest(folders: DataFrame, *keys: str) -> DataFrame:
    """The newest folder of each key, names break ties."""
    return folders.groupBy(*keys).agg(F.max_by("folder", F.struct("modified", "folder")).alias("folder"))
