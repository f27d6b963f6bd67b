"""Checks of configurations and of the texts that refer to each other."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"https?://\S+"
#: Names that stand for any name in documentation (fixed values).
PLACEHOLDERS = ["skill-name", "my-skill", "my-skill-name", "name", "foo", "bar", "example", "your-skill", "target-skill"]


def skill_references(texts: DataFrame, key: str, text: str, strong: list[str], weak: str, placeholders: list[str] | None = None) -> DataFrame:
    """(source, target, confidence) of names that texts refer to outside web addresses, each once, none to itself.

    strong: patterns whose first group is surely a name; what only the weak pattern finds is weak.
    """
    plain = F.regexp_replace(text, _URL, " ")
    every = lambda p: F.regexp_extract_all(plain, F.lit(p), F.lit(1))
    sure = F.array_distinct(F.flatten(F.array(*map(every, strong))))
    rows = texts.select(F.col(key).alias("source"), sure.alias("s"), every(weak).alias("w"))
    pairs = F.concat(
        F.transform("s", lambda t: F.struct(t.alias("target"), F.lit("strong").alias("confidence"))),
        F.transform(F.array_except("w", "s"), lambda t: F.struct(t.alias("target"), F.lit("weak").alias("confidence"))),
    )
    named = rows.select("source", F.inline(pairs))
    return named.filter((F.col("source") != F.col("target")) & ~F.col("target").isin(placeholders if placeholders is not None else PLACEHOLDERS))


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; what climbs above the top begins with .. ."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def script_references(skills: DataFrame, files: DataFrame, pattern: str = r"(?<![\w/.-])((?:\.\./)*scripts/[\w./-]+\.(?:py|sh|js))") -> DataFrame:
    """(source, target, found, confidence) of scripts that skills (name, folder, content) refer to, against the inventory (path).

    A path that leads outside the project cannot be checked: it is weak and not found.
    """
    refs = skills.select(F.col("name").alias("source"), "folder", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("target"))
    refs = refs.withColumn("path", normal_path(F.concat_ws("/", "folder", "target")))
    outside = F.col("path").startswith("..")
    met = refs.join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    return met.select("source", "target", (~outside & F.coalesce("_there", F.lit(False))).alias("found"), F.when(outside, "weak").otherwise("strong").alias("confidence"))


def config_references(configs: DataFrame, known: DataFrame, runner: str, placeholders: list[str] | None = None) -> DataFrame:
    """(source, target, found) of the skills that configurations (name, skill, runner_type) of one runner name, each once."""
    refs = configs.filter((F.col("runner_type") == runner) & ~F.col("skill").isin(placeholders if placeholders is not None else PLACEHOLDERS)).select(F.col("name").alias("source"), F.col("skill").alias("target")).distinct()
    last = F.element_at(F.split("target", "[:/]"), -1)
    names = known.select(F.col("name").alias("_k")).distinct()
    whole = refs.withColumn("_last", last).join(names.withColumnsRenamed({"_k": "target"}).withColumn("_w", F.lit(True)), "target", "left")
    return whole.join(names.withColumnsRenamed({"_k": "_last"}).withColumn("_p", F.lit(True)), "_last", "left").select("source", "target", F.coalesce("_w", "_p", F.lit(False)).alias("found"))


def without_description(skills: DataFrame) -> DataFrame:
    return skills.filter("coalesce(trim(description), '') = ''")


def template_variables(template: Column) -> Column:
    """Root names of the variables of a template, sorted; names that it sets itself or loops over are none."""
    used = F.regexp_extract_all(template, F.lit(r"\{\{-?\s*([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    tested = F.regexp_extract_all(template, F.lit(r"\{%-?\s*(?:if|elif)\s+(?:not\s+)?([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    looped = F.regexp_extract_all(template, F.lit(r"\{%-?\s*for\s+[\w, ]+\s+in\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    own = F.concat(
        F.regexp_extract_all(template, F.lit(r"\{%-?\s*set\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)),
        F.flatten(F.transform(F.regexp_extract_all(template, F.lit(r"\{%-?\s*for\s+([\w, ]+?)\s+in\s"), F.lit(1)), lambda g: F.split(g, r",\s*"))),
        F.array(F.lit("loop"), F.lit("range"), F.lit("dict"), F.lit("true"), F.lit("false"), F.lit("none")),
    )
    return F.array_sort(F.array_except(F.concat(used, tested, looped), own))


def undefined_variables(judges: DataFrame, outputs: list[str], standard: list[str]) -> DataFrame:
    """(name, undefined) of judges whose templates (prompt) use variables that are neither outputs nor standard ones."""
    available = F.array(*[F.lit(n) for n in [*outputs, *standard]]).cast("array<string>")
    return judges.select("name", F.array_except(template_variables(F.col("prompt")), available).alias("undefined")).filter(F.size("undefined") > 0)


def missing_fields(judges: DataFrame, cases: DataFrame) -> DataFrame:
    """(name, field) of judge fields that none of the first three cases by name has: a spot check, the limit is the feature."""
    first = cases.select("case_id").distinct().orderBy("case_id").limit(3)
    there = cases.join(first, "case_id", "left_semi").select(F.explode("fields").alias("field")).distinct()
    return judges.select("name", F.explode("fields").alias("field")).distinct().join(there, "field", "left_anti").select("name", "field")


def stale_fields(references: DataFrame, present: DataFrame) -> DataFrame:
    """(judge, field) of fields that judges read and no case has any more, for judges that failed every case."""
    return references.filter("failed_every_case").select("judge", F.explode("fields").alias("field")).distinct().join(present.select(F.explode("fields").alias("field")).distinct(), "field", "left_anti").select("judge", "field")


def moved_members(wrong: Column, right: Column, names: list[str]) -> Column:
    """Struct (input, annotations) of two maps, members of the given names moved from the first to the second."""
    given = F.array(*[F.lit(n) for n in names])
    moved = F.map_filter(wrong, lambda k, v: F.array_contains(given, k))
    kept = F.map_filter(F.coalesce(right, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(moved, k), F.lit(False)))
    return F.struct(F.map_filter(wrong, lambda k, v: ~F.array_contains(given, k)).alias("input"), F.map_concat(kept, moved).alias("annotations"))


def tool_patterns(text: Column, known: list[str]) -> Column:
    """Tools that a description names, and mcp patterns; else Bash where it speaks of scripts or an api, else all."""
    low = F.lower(text)
    named = F.filter(F.array(*[F.lit(t) for t in known]).cast("array<string>"), lambda t: F.contains(low, F.lower(t)))
    found = F.concat(named, F.regexp_extract_all(text, F.lit(r"(mcp__\w+(?:__\w+)*(?:\*)?)"), F.lit(1)))
    return F.when(F.size(found) > 0, found).when(F.contains(low, F.lit("script")) | F.contains(low, F.lit("api")), F.array(F.lit("Bash"))).otherwise(F.array(F.lit("*")))


def permission_rules(rules: DataFrame, path_tools: list[str], harden: bool = False) -> DataFrame:
    """(position, rule) of rules (position, rule, path, tools): plain ones as they are, paths for each tool they can bound; each once, the first stands.

    harden: a denied path for Bash also denies reading and editing it.
    """
    more = F.when(F.array_contains("tools", "Bash"), F.array(F.lit("Read"), F.lit("Edit"))).otherwise(F.array().cast("array<string>")) if harden else F.array().cast("array<string>")
    tools = F.array_distinct(F.concat(F.filter("tools", lambda t: t.isin(path_tools)), more))
    spelled = F.transform(tools, lambda t: F.concat(t, F.lit("("), F.col("path"), F.lit(")")))
    made = F.when(F.col("rule").isNotNull(), F.array("rule")).when(F.coalesce("path", F.lit("")) != "", spelled)
    rows = rules.select("position", F.posexplode(made).alias("_k", "rule"))
    return rows.groupBy("rule").agg(F.min(F.struct("position", "_k")).alias("p")).select("p.position", "rule")


def artifact_type(name: Column, types: dict[str, str]) -> Column:
    """Type of a file: by its name, else by the first pattern that fits; '' if there is none."""
    exact = [F.when(name == k, v) for k, v in types.items()]
    globs = [F.when(name.rlike(re.sub(r"\\Z$|\\z$", "$", fnmatch.translate(k))), v) for k, v in types.items()]
    return F.coalesce(*exact, *globs, F.lit("")) if types else F.lit("")


def front_matter_keys(head: Column) -> Column:
    """Top-level keys of a front-matter block, sorted; null where there is no block."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w.-]*)\s*:"), F.lit(1))))


def named_actions(skill: Column) -> Column:
    """The command that a run did not know, of a result document without turns."""
    turns = F.try_variant_get(skill, "$.num_turns", "double")
    said = F.try_variant_get(skill, "$.result", "string")
    return F.when(F.coalesce(turns, F.lit(0.0)) <= 0, F.nullif(F.regexp_extract(F.trim(said), r"^Unknown command: (/\S+)", 1), F.lit("")))
