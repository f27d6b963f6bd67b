"""What reports show: labels, ranks, differences of texts, the graph of references."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions.scalars import slug


def unique_slugs(rows: DataFrame, name: str, order: str, path_safe: bool = False) -> DataFrame:
    """rows with slug, each once: in order, a repeated base takes the first free of -2, -3, ...

    A numbered slug may meet a base of that spelling: only where several bases are the same but for a number
    at their end are these rows settled one after the other, all others are numbered by a window.
    path_safe: letters of either case, dots and underscores stay, an empty slug becomes run.
    """
    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("run")) if path_safe else slug(F.col(name))
    based = rows.withColumn("_base", base)
    family = F.regexp_replace("_base", r"(-\d+)+$", "")
    schema = T.StructType([*based.schema.fields, T.StructField("slug", T.StringType())])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        used, after, out = set(), {}, []
        for b in group["_base"]:
            s, k = b, after.get(b, 2)
            while s in used:
                s, k = f"{b}-{k}", k + 1
            after[b] = k
            used.add(s)
            out.append(s)
        return group.assign(slug=out)

    sizes = based.groupBy(family.alias("_family")).agg((F.min("_base") != F.max("_base")).alias("_mixed"))
    both = based.withColumn("_family", family).join(sizes, "_family")
    number = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    plain = both.filter("not _mixed").withColumn("_k", number).withColumn("slug", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_k")))
    mixed = both.filter("_mixed").drop("_mixed").groupBy("_family").applyInPandas(lambda g: settle(g.drop(columns="_family")), schema)
    return plain.drop("_family", "_mixed", "_base", "_k").unionByName(mixed.drop("_base"))


def rank_colour(value: str, scope: list[str], higher_is_better: bool = True) -> Column:
    """best, worst or other within a scope; null where fewer than two values differ."""
    w = Window.partitionBy(*scope)
    low, high = F.min(value).over(w), F.max(value).over(w)
    best, worst = (high, low) if higher_is_better else (low, high)
    return F.when(low < high, F.when(F.col(value) == best, "best").when(F.col(value) == worst, "worst").otherwise("other"))


def line_changes(old: str, new: str) -> tuple[int, int]:
    """(added, deleted) lines by sequence matching."""
    added = deleted = 0
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old.splitlines(), new.splitlines(), autojunk=False).get_opcodes():
        if kind != "equal":
            deleted += b - a
            added += d - c
    return added, deleted


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("deleted", T.IntegerType())]))
def diff_stats(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Added and deleted lines; null counts as empty."""
    pairs = [line_changes(a if isinstance(a, str) else "", b if isinstance(b, str) else "") for a, b in zip(old, new)]
    return pd.DataFrame(pairs, columns=["added", "deleted"])


def json_in(text: str) -> str | None:
    """The first JSON object in a text: fenced, or behind prose, found by a balanced scan; null if none is valid."""
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(text, at)
            return json.dumps(value)
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json_in(t) if isinstance(t, str) else None)


def references(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Edges (source, target) that a pattern finds in texts outside web addresses, each once, none to itself."""
    plain = F.regexp_replace(text, r"https?://\S+", " ")
    found = texts.select(F.col(key).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)))).alias("target"))
    return found.filter("source != target")


def resolve(edges: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Edges with resolved: the target, or its last segment, is a known name."""
    names = known.select(F.col(name).alias("_known")).distinct()
    whole = edges.join(names.select(F.col("_known").alias("target"), F.lit(True).alias("_whole")), "target", "left")
    last = whole.withColumn("_last", F.element_at(F.split("target", "[:/]"), -1)).join(names.select(F.col("_known").alias("_last"), F.lit(True).alias("_part")), "_last", "left")
    return last.select("source", "target", F.coalesce("_whole", "_part", F.lit(False)).alias("resolved"))


def orphans(known: DataFrame, name: str, edges: DataFrame) -> DataFrame:
    """Known rows that no reference names, wholly or by its last segment."""
    named = edges.select(F.explode(F.array("target", F.element_at(F.split("target", "[:/]"), -1))).alias("_n")).distinct()
    return known.join(named, F.col(name) == F.col("_n"), "left_anti")
