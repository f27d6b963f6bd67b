"""Scalar functions as Columns: text caps, ids, labels, bands, verdicts from free text, times."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_CAP = 50_000


def truncate(value: Column, cap: int = RESULT_CAP) -> Column:
    """The first cap code points and a mark, where a value is longer."""
    return F.when(F.length(value) > cap, F.concat(F.left(value, F.lit(cap)), F.lit("[truncated]"))).otherwise(value)


def normalise(value: Column, low: float | Column, high: float | Column) -> Column:
    """(value - low) / (high - low) within [0, 1]; 0 for an empty range, null for null."""
    low, high = (F.lit(x) if isinstance(x, (int, float)) else x for x in (low, high))
    return F.when(value.isNull(), F.lit(None).cast("double")).when(high - low <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def safe_segment(value: Column) -> Column:
    """Letters, digits, dot, hyphen; anything else an underscore, none at the ends."""
    return F.btrim(F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_"), F.lit("_"))


def canonical_json(levels: dict[str, Column]) -> Column:
    """Sorted JSON text of string levels with a blank after each separator, non-ASCII escaped by the caller."""
    quote = lambda c: F.to_json(F.array(c))
    parts = [F.concat(F.lit(json.dumps(k) + ": "), F.regexp_replace(quote(levels[k]), r"^\[|\]$", "")) for k in sorted(levels)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def condition_id(levels: dict[str, Column]) -> Column:
    """First twelve digits of the SHA-256 of the canonical levels."""
    return F.left(F.sha2(canonical_json(levels), 256), F.lit(12))


def short_model(model: Column, known: dict[str, str] | None = None) -> Column:
    """A label of a model id: a known one, else the family in capitals with its version and its suffix, else the id itself."""
    pattern = r"^claude-([a-z]+)-([0-9]+(?:-[0-9]+)*)(\[.*\])?$"
    part = lambda k: F.regexp_extract(model, pattern, k)
    derived = F.concat(F.initcap(part(1)), F.lit(" "), F.replace(part(2), F.lit("-"), F.lit(".")), F.when(part(3) != "", F.concat(F.lit(" "), F.upper(part(3)))).otherwise(""))
    listed = [F.when(model == k, v) for k, v in (known or {}).items()]
    return F.coalesce(*listed, F.when(model.rlike(pattern), derived), model)


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def iso_nanos(stamp: Column) -> Column:
    """ISO 8601 to nanoseconds since 1970, exact to the microsecond; null if unreadable."""
    return F.unix_micros(stamp.try_cast("timestamp")) * 1000


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def effect_band(value: Column) -> Column:
    """small below 0.06, medium below 0.14, else large."""
    return F.when(value < 0.06, "small").when(value < 0.14, "medium").otherwise("large")


def score_band(value: Column, low: float, high: float) -> Column:
    """pass from three quarters of the scale, warn from three eighths, else fail; off the scale is fail."""
    share = (value - low) / (high - low)
    return F.when(~value.between(low, high), "fail").when(share >= 0.75, "pass").when(share >= 0.375, "warn").otherwise("fail")


def reward_band(value: Column) -> Column:
    return F.when(value >= 0.40, "good").when(value >= 0.30, "fair").otherwise("poor")


def suffix_match(a: Column, b: Column) -> Column:
    """Equal paths, or one a suffix of the other at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def billed_cost(conversation: Column, models: Column) -> Column:
    """The sum over models where it is higher by more than a cent."""
    return F.when(models > F.coalesce(conversation, F.lit(0.0)) + 0.01, models).otherwise(conversation)


def is_denial(text: Column) -> Column:
    """Whether an error says that a permission was missing (fixed phrases, any letter case)."""
    return F.coalesce(text.rlike(r"(?i)permission denied|not allowed|disallowed|not permitted|user denied"), F.lit(False))


def is_real_model(name: Column) -> Column:
    """Model names in angle brackets are stand-ins."""
    return ~(name.startswith("<") & name.endswith(">"))


def number_text(value: Column) -> Column:
    """2.0 as 2, 2.5 as 2.5."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def tool_failed(result: Column) -> Column:
    """A result that is an object with a member error that is not empty, or a text with "error" in its first 50 characters."""
    document = F.try_parse_json(result)
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    member = F.to_json(F.try_variant_get(document, "$.error", "variant"))
    named = ~F.coalesce(member, F.lit("null")).isin("null", '""', "false", "0", "{}", "[]")
    return F.coalesce(F.when(is_object, named).otherwise(F.instr(F.lower(F.left(result, F.lit(50))), "error") > 0), F.lit(False))


def text_of(value: Column, kind: str = "num") -> Column:
    """A number as reports show it: usd, pct, int, time, tokens or plain with two digits; -- for null."""
    whole = F.floor(value).cast("bigint")
    forms = {
        "usd": F.concat(F.lit("$"), F.format_number(value, 2)),
        "pct": F.concat(F.format_string("%.1f", value.cast("double") * 100), F.lit("%")),
        "int": F.format_number(whole, 0),
        "time": F.when(value < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(value / 60).cast("string"), F.lit(" min"))),
        "tokens": F.when(value >= 1_000_000, F.concat(F.format_string("%.1f", value.cast("double") / 1e6), F.lit("M")))
        .when(value >= 1000, F.concat(F.format_string("%.1f", value.cast("double") / 1e3), F.lit("K")))
        .otherwise(whole.cast("string")),
    }
    return F.when(value.isNull(), "--").otherwise(forms.get(kind, F.format_string("%.2f", value.cast("double"))))


def range_text(average: Column, low: Column, high: Column, count: Column, kind: str = "num") -> Column:
    """average (low-high), the average alone for one value, -- for none."""
    both = F.concat(text_of(average, kind), F.lit(" ("), text_of(low, kind), F.lit("-"), text_of(high, kind), F.lit(")"))
    return F.when(count == 0, "--").when(count == 1, text_of(average, kind)).otherwise(both)


def strict_number(document: Column, path: str) -> Column:
    """A number of a document; a flag or a text is none."""
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(document, path, "double"))


def strict_int(document: Column, path: str) -> Column:
    """A whole number of a document, 0 for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.coalesce(F.when(kind.startswith("BIGINT"), F.try_variant_get(document, path, "bigint")), F.lit(0))


def seconds_between(started: Column, finished: Column) -> Column:
    """Seconds between two ISO 8601 times, at least 0; null if one cannot be read."""
    at = lambda c: F.unix_micros(c.try_cast("timestamp"))
    return F.greatest((at(finished) - at(started)) / 1e6, F.lit(0.0))


def tool_summary(name: Column, arguments: Column) -> Column:
    """What a call is about, in a line: its path, command, pattern, query or first argument (arguments as JSON text)."""
    v = F.try_parse_json(arguments)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
    known = lambda *keys: F.coalesce(*map(get, keys), F.lit("?"))
    some = lambda k: F.when(~F.coalesce(get(k), F.lit("")).isin("", "0", "false"), F.concat(F.lit(k + "="), get(k)))
    filled = lambda k: F.nullif(get(k), F.lit(""))
    members = F.map_entries(F.from_json(arguments, "map<string,string>"))
    first = F.get(members, F.lit(0))
    return (
        F.when(name == "Read", F.concat_ws(", ", known("file_path"), some("offset"), some("limit")))
        .when(name == "Bash", cut(known("command"), 200))
        .when(name == "Agent", F.coalesce(F.concat(F.lit('"'), filled("description"), F.lit('"')), cut(filled("prompt"), 100), F.lit("(no description)")))
        .when(name.isin("Edit", "Write"), known("file_path"))
        .when(name.isin("Glob", "Grep"), known("pattern", "query"))
        .when(name == "WebFetch", known("url"))
        .when(name == "WebSearch", known("query"))
        .when(name == "Skill", known("skill"))
        .otherwise(F.coalesce(F.concat(first["key"], F.lit("="), cut(first["value"], 100)), F.lit("(no input)")))
    )


def unescaped(text: Column) -> Column:
    """Written line breaks and tabs as such."""
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def front_matter(text: Column) -> Column:
    """(head, body) of a text with a block between lines of three hyphens; head is null where there is none."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("head"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))
