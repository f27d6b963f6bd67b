"""Operators over runs: estimated cost, denials, coverage of expected files, handlers, file groups, links, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.scalars import suffix_match


def estimated_cost(turns: DataFrame, prices: DataFrame, key: str, model: str) -> DataFrame:
    """Cost of each key from token prices; null where no turn has a price.

    A model is looked up whole, without its first path segment, and by its last one, in this order. prices:
    (price_model, per_input, per_cached, per_output) for a token.
    """
    candidates = F.array_distinct(F.array(F.col(model), F.regexp_replace(model, "^[^/]*/", ""), F.element_at(F.split(model, "/"), -1)))
    names = turns.select(model).distinct().select(model, F.posexplode(candidates).alias("rank", "price_model"))
    found = names.join(prices, "price_model").groupBy(model).agg(F.min_by(F.struct("per_input", "per_cached", "per_output"), "rank").alias("p"))
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))
    cost = fresh * F.col("p.per_input") + F.col("cached_tokens") * F.col("p.per_cached") + F.col("output_tokens") * F.col("p.per_output")
    return turns.join(found, model, "left").groupBy(key).agg(F.sum(cost).alias("cost_usd"))


def merged_usage(rows: DataFrame, *keys: str) -> DataFrame:
    """Tokens and cost by model; the cost stays null until a number is seen, tokens start at 0."""
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")], F.sum("cost_usd").alias("cost_usd")
    )


def denials(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Denied calls of a scope, the first of each id; those without an id all stay."""
    first = F.row_number().over(Window.partitionBy(*scope, "tool_use_id").orderBy(order))
    known = rows.filter("tool_use_id is not null").withColumn("_n", first).filter("_n = 1").drop("_n")
    return known.unionByName(rows.filter("tool_use_id is null"))


def coverage(cases: DataFrame, expected: str, read: str, least: float = 0.8) -> DataFrame:
    """cases with the share of expected files that were read, and covered; nothing expected is covered.

    Paths match if they are equal or one ends with the other at a slash. A file expected twice counts twice.
    """
    hits = F.filter(expected, lambda e: F.exists(read, lambda r: suffix_match(r, e)))
    share = F.try_divide(F.size(hits), F.size(expected))
    return cases.withColumn("coverage", share).withColumn("covered", F.coalesce(share >= least, F.lit(True)))


def handlers(calls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """calls with the first rule whose pattern is the tool's name or, ending in *, begins it, and whose input
    filter, where it has one, the input matches. rules: (rule_no, pattern, input_filter), a bounded configuration;
    plain patterns meet by equality, only those with * are compared one by one.
    """
    plain = calls.join(rules.filter("not endswith(pattern, '*')"), F.col("name") == F.col("pattern"))
    prefix = rules.filter("endswith(pattern, '*')").withColumn("_head", F.expr("left(pattern, length(pattern) - 1)"))
    starred = calls.join(prefix, F.startswith("name", "_head")).drop("_head")
    met = plain.unionByName(starred).filter("input_filter is null or rlike(coalesce(input, ''), input_filter)")
    first = met.groupBy(key).agg(F.min("rule_no").alias("rule_no"))
    return calls.join(first, key, "left")


def file_groups(files: DataFrame, cases: int) -> DataFrame:
    """files (name) with their group: WORD-NNN of the name if such groups are at least half as many as the cases,
    else each file for itself."""
    word = F.nullif(F.regexp_extract("name", r"([A-Za-z]+-\d+)", 1), F.lit(""))
    named = files.withColumn("_g", word)
    groups = named.agg(F.countDistinct("_g")).first()[0]
    return named.withColumn("group", F.coalesce("_g", "name") if groups * 2 >= cases else F.col("name")).drop("_g")


def unlinked_traces(traces: DataFrame, linked: DataFrame) -> DataFrame:
    """The first trace of each run tag that no feedback is linked to yet."""
    free = traces.filter("run_tag is not null").join(linked.select("trace_id").distinct(), "trace_id", "left_anti")
    return free.groupBy("run_tag").agg(F.min_by("trace_id", F.struct("at", "trace_id")).alias("trace_id"))


def run_traces(traces: DataFrame, run_tag: str | None = None, since: Column | None = None, most: int = 100) -> DataFrame:
    """The newest traces of a run within a time, at most `most`: a listing, the limit is the feature."""
    found = traces if run_tag is None else traces.filter(F.col("run_tag") == run_tag)
    found = found if since is None else found.filter(F.col("at") >= since)
    return found.orderBy(F.desc("at"), "trace_id").limit(most)


def case_folders(cases: DataFrame, folders: DataFrame) -> DataFrame:
    """cases (case_id) with their folder: the one of that name, else the only one that begins with it."""
    exact = cases.join(folders.withColumn("case_id", F.col("folder")), "case_id", "left")
    open_ = exact.filter("folder is null").select("case_id")
    # every beginning of a folder's name meets the cases by equality
    heads = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.length("folder")), lambda k: F.left(F.col("folder"), k))).alias("case_id"))
    begun = open_.join(heads, "case_id").groupBy("case_id").agg(F.count("*").alias("n"), F.min("folder").alias("folder")).filter("n = 1").drop("n")
    return exact.filter("folder is not null").select("case_id", "folder").unionByName(open_.join(begun, "case_id", "left"))


def overlay(base: Column, over: Column, fixed: str) -> Column:
    """Tags of both maps, those of over winning except for one fixed name."""
    kept = F.map_filter(over, lambda k, v: k != fixed)
    lower = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(kept, k), F.lit(False)))
    return F.map_concat(lower, F.coalesce(kept, F.create_map().cast("map<string,string>")))
