"""Designs and their analysis: factor matrices, common cases, analysis of variance, mixed effects."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions.scalars import condition_id


def full_factorial(spark: SparkSession, factors: dict[str, list[str]]) -> DataFrame:
    """All combinations of factor levels, factors by name, the last varying fastest, with their condition_id.

    The table has as many rows as the configuration says; it is numbered and decoded, not joined.
    """
    names = sorted(factors)
    total = math.prod(len(factors[n]) for n in names)
    out, step = spark.range(total).withColumnRenamed("id", "position"), total
    for n in names:
        step //= max(1, len(factors[n]))
        levels = F.array(*[F.lit(str(x)) for x in factors[n]])
        out = out.withColumn(n, F.get(levels, F.floor(F.col("position") / step) % len(factors[n])))
    return out.withColumn("condition_id", condition_id({n: F.col(n) for n in names}))


def common_cases(rows: DataFrame, case: str, condition: str) -> DataFrame:
    """Relational division: rows of the cases that every condition has; all rows if there is no such case."""
    pairs = rows.select(case, condition).distinct()
    every = pairs.agg(F.count_distinct(condition).alias("_every"))
    counts = pairs.groupBy(case).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(every))  # one row
    some = counts.agg(F.coalesce(F.bool_or(F.col("_n") == F.col("_every")), F.lit(False)).alias("_any"))
    fine = counts.crossJoin(F.broadcast(some)).filter("_n = _every or not _any")  # one row
    return rows.join(fine.select(case), case, "left_semi")


def excluded_cases(rows: DataFrame, case: str, condition: str) -> DataFrame:
    """Cases that not every condition has."""
    pairs = rows.select(case, condition).distinct()
    every = pairs.agg(F.count_distinct(condition).alias("_every"))
    return pairs.groupBy(case).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(every)).filter("_n < _every").select(case)  # one row


def replication_number(runs: DataFrame, condition: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(condition).orderBy(order)) - 1


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            num = 1.0
        elif k % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, df1: float, df2: float) -> float:
    """Probability of an F value this large or larger."""
    if not (f >= 0 and df1 > 0 and df2 > 0) or math.isinf(f):
        return float("nan")
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_tail(z: float) -> float:
    """Two-sided probability of a standard normal value."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def f_probability(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else f_tail(x, a, b) for x, a, b in zip(f, df1, df2)], dtype="float64")


def repeated_measures(rows: DataFrame, subject: str, factor: str, response: str) -> DataFrame:
    """One row (f, df1, df2, ss_factor, ss_error) of the one-way analysis with repeated measures.

    Cells with several rows count by their mean; subjects without every level are left out. f is null where
    the error is nil against the total (equal responses, a constant shift).
    """
    cells = rows.filter(F.col(response).isNotNull()).groupBy(subject, factor).agg(F.avg(response).alias("y"))
    full = common_cases(cells, subject, factor)
    grand = full.agg(F.avg("y").alias("g"), F.countDistinct(factor).alias("k"), F.countDistinct(subject).alias("n"))
    by_level = full.groupBy(factor).agg(F.avg("y").alias("ml"))
    by_subject = full.groupBy(subject).agg(F.avg("y").alias("ms"))
    joined = full.join(by_level, factor).join(by_subject, subject).crossJoin(F.broadcast(grand))  # grand has one row
    sums = joined.agg(
        F.sum((F.col("ml") - F.col("g")) ** 2).alias("ss_factor"),
        F.sum((F.col("y") - F.col("ml") - F.col("ms") + F.col("g")) ** 2).alias("ss_error"),
        F.sum((F.col("y") - F.col("g")) ** 2).alias("ss_total"),
        F.max("k").alias("k"),
        F.max("n").alias("n"),
    )
    df1, df2 = (F.col("k") - 1).cast("double"), ((F.col("k") - 1) * (F.col("n") - 1)).cast("double")
    f = F.when(F.col("ss_error") > 1e-12 * F.col("ss_total"), F.try_divide(F.col("ss_factor") / df1, F.col("ss_error") / df2))
    return sums.select(f.alias("f"), df1.alias("df1"), df2.alias("df2"), "ss_factor", "ss_error")


def sphericity(rows: DataFrame, subject: str, factor: str, response: str) -> DataFrame:
    """One row (epsilon) of Greenhouse and Geisser: how far the covariances of the levels are from equal ones.

    The covariance of two levels is a sum over the subjects that have both, so only a matrix as wide as the
    factor has levels is ever held, by the one task that sums it up.
    """
    cells = rows.filter(F.col(response).isNotNull()).groupBy(subject, factor).agg(F.avg(response).alias("y"))
    full = common_cases(cells, subject, factor)
    means = full.groupBy(factor).agg(F.avg("y").alias("m"))
    centred = full.join(means, factor).select(subject, F.col(factor).cast("string").alias("f"), (F.col("y") - F.col("m")).alias("e"))
    # each subject has as many rows as the factor has levels
    vectors = centred.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("v"))
    pairs = vectors.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b"))
    cov = pairs.groupBy(F.col("a.f").alias("f"), F.col("b.f").alias("g")).agg(F.sum(F.col("a.e") * F.col("b.e")).alias("c"))
    by_row = cov.groupBy("f").agg(F.avg("c").alias("row"), F.sum(F.when(F.col("f") == F.col("g"), F.col("c"))).alias("diagonal"), F.sum(F.col("c") ** 2).alias("squares"))
    k = F.count("*")
    every, diagonal, squares, rows2 = F.avg("row"), F.avg("diagonal"), F.sum("squares"), F.sum(F.col("row") ** 2)
    value = (k * (diagonal - every)) ** 2 / ((k - 1) * (squares - 2 * k * rows2 + k * k * every**2))
    return by_row.agg(F.when(k >= 2, F.least(F.lit(1.0), F.greatest(value, 1.0 / (k - 1)))).alias("epsilon"))


def repeated_measures_p(rows: DataFrame, subject: str, factor: str, response: str, alpha: float = 0.05) -> DataFrame:
    """One row (f, df1, df2, p_uncorrected, epsilon, p_value, significant): p_value is corrected for sphericity.

    All are null where f is.
    """
    out = repeated_measures(rows, subject, factor, response).crossJoin(F.broadcast(sphericity(rows, subject, factor, response)))  # one row each
    out = out.withColumn("p_uncorrected", f_probability("f", "df1", "df2")).withColumn("p_value", f_probability("f", F.col("df1") * F.col("epsilon"), F.col("df2") * F.col("epsilon")))
    return out.select("f", "df1", "df2", "p_uncorrected", "epsilon", "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"))


def one_way(rows: DataFrame, factor: str, response: str) -> DataFrame:
    """One row (f, df1, df2) of the one-way analysis of independent groups, from the moments of each level."""
    groups = rows.filter(F.col(response).isNotNull()).groupBy(factor).agg(F.count("*").alias("n"), F.avg(response).alias("m"), F.var_pop(response).alias("v"))
    sums = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    between = F.col("s2") - F.col("s") ** 2 / F.col("n")
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return sums.select(F.try_divide(between / df1, F.col("within") / df2).alias("f"), df1.alias("df1"), df2.alias("df2"))


def _reml(y: np.ndarray, x: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors of a random-intercept model, by a search over the ratio of variances."""
    members = [np.nonzero(groups == g)[0] for g in np.unique(groups)]
    n, p = x.shape

    def fit(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        xx, xy, log_det = np.zeros((p, p)), np.zeros(p), 0.0
        for m in members:
            shrink = ratio / (1 + ratio * len(m))
            xs, ys = x[m].sum(0), y[m].sum()
            xx += x[m].T @ x[m] - shrink * np.outer(xs, xs)
            xy += x[m].T @ y[m] - shrink * xs * ys
            log_det += math.log1p(ratio * len(m))
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = 0.0
        for m in members:
            r = y[m] - x[m] @ beta
            rss += r @ r - ratio / (1 + ratio * len(m)) * r.sum() ** 2
        scale = max(rss, 1e-300) / max(1, n - p)
        return (n - p) * math.log(scale) + log_det + np.linalg.slogdet(xx)[1], beta, xx, scale

    low, high = -12.0, 12.0  # of the logarithm of the ratio
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fit(math.exp(a))[0] < fit(math.exp(b))[0] else (a, high)
    best = min((0.0, math.exp((low + high) / 2)), key=lambda r: fit(r)[0])
    _, beta, xx, scale = fit(best)
    return beta, np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(xx)) * scale))


def mixed_effects(rows: DataFrame, subject: str, factors: list[str], response: str) -> DataFrame:
    """Rows (factor, p_value): the least Wald p of a factor's main contrasts in a random-intercept REML model.

    The fit runs over the cell means of conditions and cases, whose number the design bounds; all interactions
    enter the model but not the p of a factor.
    """
    cells = rows.filter(F.col(response).isNotNull()).groupBy(subject, *factors).agg(F.avg(response).alias("y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(batches))
        if not len(data):
            return
        columns, owner = [np.ones(len(data))], [""]
        parts: dict[str, list[np.ndarray]] = {}
        for f in factors:
            levels = sorted(data[f].astype(str).unique())[1:]
            parts[f] = [(data[f].astype(str) == level).to_numpy(float) for level in levels]
            columns += parts[f]
            owner += [f] * len(levels)
        for size in range(2, len(factors) + 1):
            for chosen in itertools.combinations(factors, size):
                for product in itertools.product(*[parts[f] for f in chosen]):
                    columns.append(np.prod(product, axis=0))
                    owner.append("")
        beta, error = _reml(data["y"].to_numpy(float), np.column_stack(columns), data[subject].astype(str).to_numpy())
        p = [normal_tail(b / e) if e > 0 else float("nan") for b, e in zip(beta, error)]
        out = [(f, np.nanmin([q for q, o in zip(p, owner) if o == f] or [np.nan])) for f in factors]
        yield pd.DataFrame(out, columns=["factor", "p_value"])

    return cells.coalesce(1).mapInPandas(fit, "factor string, p_value double")
