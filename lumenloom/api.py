"""Entries for users: read runs, score, compare, analyse, report, and ask in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import analysis, compare, scoring
from lumenloom.operators import judging as J
from lumenloom.operators import statistics as A
from lumenloom.operators import transcripts as E
from lumenloom.operators.scoring import Judge, Registry, score_cases
from lumenloom.session import table
from lumenloom.sources import cases as C
from lumenloom.sources.files import documents, judge_results, transcript_files

__all__ = ["Judge", "Registry", "analyze", "compare_models", "compose_reward", "design", "ingest", "pairwise", "register", "regressions", "report_tables", "score_cases", "summarize"]

compose_reward, regressions, design, summarize = J.compose_reward, J.regressions, A.full_factorial, scoring.summary


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views of Parquet tables, for spark.sql."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


@dataclass
class Runs:
    """Tables of a folder of runs: lines and events of transcripts, cases, judge results, run results and summaries."""

    lines: DataFrame
    events: DataFrame
    results: DataFrame
    run_results: DataFrame
    summaries: DataFrame

    def register(self, prefix: str = "") -> Runs:
        for name, df in vars(self).items():
            df.createOrReplaceTempView(prefix + name)
        return self


def ingest(spark: SparkSession, root: str) -> Runs:
    """Everything that the runs below root hold; unreadable documents are null and lines that are no JSON give no events."""
    lines = transcript_files(spark, root).withColumn("line_id", F.xxhash64("run_id", "file_name", "line_no"))
    summaries = documents(spark, root, "summary.yaml")
    return Runs(lines, E.flat_events(lines), judge_results(summaries), documents(spark, root, "run_result.json"), summaries)


def pairwise(cases: DataFrame, ab: str = "ab", ba: str = "ba") -> tuple[DataFrame, DataFrame]:
    """(winner of each case, tally) of comparisons made in both orders."""
    judged = cases.withColumn("winner", J.winner(F.col(ab), F.col(ba)))
    return judged, J.pairwise_tally(judged)


@dataclass
class Report:
    judges: DataFrame
    cases: DataFrame
    breaches: DataFrame


def report_tables(results: DataFrame, thresholds: DataFrame, baseline: DataFrame | None = None) -> Report:
    """What a report shows: judges with thresholds, baseline and status; cases with their reward; breaches."""
    current = J.judge_aggregate(results)
    before = J.judge_aggregate(baseline) if baseline is not None else None
    breaches = J.regressions(current, thresholds, before)
    return Report(compare.scoring_table(current, thresholds, breaches, before), J.compose_reward(results, "case_id"), breaches)


@dataclass
class Comparison:
    models: DataFrame
    order: DataFrame
    judges: DataFrame
    cases: DataFrame


def compare_models(runs: DataFrame, results: DataFrame, metrics: list[str], primary: str) -> Comparison:
    """Metrics by model, models by the primary judge, the judges that differ most, and the cases on which models differ.

    runs: (run, model, metrics); results: judge results with run.
    """
    named = results.join(runs.select("run", "model"), "run")
    means = J.judge_aggregate(named, "model", "judge")
    return Comparison(compare.by_model(runs, "model", metrics), compare.model_order(means, "model", primary), compare.card_judges(means), compare.case_differences(named, "model"))


def analyze(summaries: DataFrame, levels: DataFrame, factors: list[str], costs: DataFrame | None = None, alpha: float = 0.05) -> analysis.Analysis:
    """The analysis of an experiment out of the summaries of its runs and their factor levels."""
    rows, cost = C.conditions(summaries, levels, factors, costs)
    return analysis.analyse(rows, factors, cost if costs is not None else None, alpha)
