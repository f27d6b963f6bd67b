"""Analysis of an experiment: common cases, means of replications, the fitting test, summaries, frontier, design."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.operators import judging as J
from lumenloom.operators import statistics as A


@dataclass
class Analysis:
    """method: skipped, repeated measures or mixed effects; test: one row for each factor with its p value."""

    method: str
    factors: list[str]
    test: DataFrame | None
    summaries: DataFrame
    design: DataFrame
    per_case: DataFrame
    excluded: DataFrame

    def p_values(self) -> DataFrame | None:
        return None if self.test is None else self.test.select("factor", "p_value")

    def best_p(self) -> DataFrame | None:
        return None if self.test is None else self.test.agg(F.min("p_value").alias("p_value"))


def cell_means(rows: DataFrame, factors: list[str], case: str = "case_id", condition: str = "condition_id", response: str = "composite") -> DataFrame:
    """Mean of the replications of a condition and case, with its levels; null is a group of its own."""
    return rows.groupBy(condition, case).agg(F.avg(response).alias(response), *[F.min(f).alias(f) for f in factors])


def design(rows: DataFrame, factors: list[str], case: str = "case_id", condition: str = "condition_id") -> DataFrame:
    """One row: sorted levels of each factor, number of cases, most rows of a condition and case."""
    pairs = rows.groupBy(condition, case).agg(F.count("*").alias("n"), *[F.collect_set(f).alias(f) for f in factors])
    levels = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(f)))).alias(f) for f in factors]
    return pairs.agg(*levels, F.count_distinct(case).alias("n_cases"), F.coalesce(F.max("n"), F.lit(1)).alias("replications"))


def condition_label(factors: list[str]) -> Column:
    """factor=level, factor=level; a single factor by its level alone."""
    level = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None"))
    return level(factors[0]) if len(factors) == 1 else F.concat_ws(", ", *[F.concat(F.lit(f + "="), level(f)) for f in factors])


def per_case(rows: DataFrame, factors: list[str], case: str = "case_id", response: str = "composite") -> DataFrame:
    """Mean response (condition, case, mean) of each condition and case."""
    return rows.groupBy(condition_label(factors).alias("condition"), F.col(case).cast("string").alias(case)).agg(F.avg(response).alias("mean"))


def summaries(rows: DataFrame, factors: list[str], costs: DataFrame | None = None, condition: str = "condition_id", response: str = "composite") -> DataFrame:
    """For each condition its levels, mean, std, min, max, n and cost, and whether it is on the frontier of cost and mean.

    Where a cost is missing every condition is on the frontier.
    """
    out = J.replications(rows, response, condition).join(rows.groupBy(condition).agg(*[F.min(f).alias(f) for f in factors]), condition)
    if costs is None:
        return out.withColumn("cost", F.lit(None).cast("double")).withColumn("on_frontier", F.lit(True))
    out = out.join(costs.select(condition, "cost"), condition, "left")
    known = out.agg(F.coalesce(F.bool_and(F.col("cost").isNotNull()), F.lit(True)).alias("_known"))
    # one row beside a table as long as the design
    return J.frontier(out, "cost", "mean").crossJoin(F.broadcast(known)).withColumn("on_frontier", ~F.col("_known") | F.coalesce("on_frontier", F.lit(False))).drop("_known")


def analyse(rows: DataFrame, factors: list[str], costs: DataFrame | None = None, alpha: float = 0.05, case: str = "case_id", condition: str = "condition_id", response: str = "composite") -> Analysis:
    """The whole analysis of rows (case_id, condition_id, composite, a column for each factor, one row for each replication).

    Only cases that every condition has are compared, unless there are none. Factors of one level are left out
    of the test: none left means it is skipped, one means repeated measures with correction for sphericity,
    more a mixed model. The number of levels, known to the configuration, decides on the driver.
    """
    kept = A.common_cases(rows, case, condition)
    means = cell_means(kept, factors, case, condition, response)
    levels = means.agg(*[F.count_distinct(f).alias(f) for f in factors], F.count_distinct(condition).alias("_conditions")).first()
    effective = [f for f in factors if levels[f] >= 2]
    if not effective or levels["_conditions"] < 2:
        method, test = "skipped", None
    elif len(effective) == 1:
        method = "repeated measures"
        test = A.repeated_measures_p(means, case, effective[0], response, alpha).withColumn("factor", F.lit(effective[0]))
    else:
        method = "mixed effects"
        test = A.mixed_effects(means, case, effective, response).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return Analysis(method, effective, test, summaries(kept, factors, costs, condition, response), design(kept, factors, case, condition), per_case(kept, factors, case, response), A.excluded_cases(rows, case, condition))


def _segment(value: object) -> str:
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in str(value)).strip("._-") or "factor"


def experiment_id(factors: dict[str, list]) -> str:
    """Name of an experiment: its factors and twelve digits of the hash of their canonical JSON."""
    digest = hashlib.sha256(json.dumps(factors, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return "-".join(["exp", *map(_segment, sorted(factors)), digest])


def estimated_runs(conditions: int, cases: int, replications: int, cost_per_run: float) -> tuple[int, float]:
    """Runs of a design and their cost."""
    if isinstance(replications, bool) or not isinstance(replications, int) or replications < 1:
        raise ValueError("replications must be a whole number from 1")
    runs = conditions * cases * replications
    return runs, runs * cost_per_run


def cell_run_id(date: str, levels: dict[str, object], replication: int, replications: int) -> str:
    """Id of the run of a cell: date, model, other factors by name, and the number of a repeated one."""
    named = [_segment(levels["model"])] if "model" in levels else []
    named += [f"{_segment(k)}-{_segment(levels[k])}" for k in sorted(levels) if k != "model"]
    tail = [f"r{replication + 1}"] if replications > 1 else []
    return "-".join([date, *(named or ["cell"]), *tail])
