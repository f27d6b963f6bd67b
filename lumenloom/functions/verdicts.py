"""Verdicts of judges out of free text: JSON where it is given, else prose; scales and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?"
#: Names under which judges give their reasons (fixed values).
REASONING = ["reasoning", "analysis", "rationale", "explanation", "scratchpad", "summary", "justification", "notes"]


def bound_text(value: float) -> str:
    """2.0 as 2, 2.5 as 2.5."""
    return str(int(value)) if float(value).is_integer() else str(float(value))


def numeric_bounds(feedback: str | None, scale: tuple[float, float] | None) -> tuple[float, float, bool] | None:
    """(low, high, whole numbers only) of a judge; none for flags. Without a declared type, whole bounds mean whole scores."""
    if feedback == "bool":
        return None
    low, high = scale or (1.0, 5.0)
    whole = feedback == "int" or feedback != "float" and float(low).is_integer() and float(high).is_integer()
    return float(low), float(high), whole


def feedback_type(name: Column) -> Column:
    """bool, int, float or str of a declared type name; null for others."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("bool", "boolean"), "bool").when(low.isin("int", "integer"), "int").when(low.isin("float", "number", "double"), "float").when(low.isin("str", "string"), "str")


def whole_number(value: Column, whole: bool) -> Column:
    """A score as the scale asks for it: whole ones are rounded half to even."""
    return F.bround(value.cast("double"), 0) if whole else value.cast("double")


def json_object(text: Column) -> Column:
    """The JSON object of a response, fenced, bare, or from the first brace to the last; null if none is valid."""
    body = F.trim(text)
    fenced = F.nullif(F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, body)
    outer = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    is_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(is_object(F.try_parse_json(body)), is_object(F.try_parse_json(outer)))


def rationale(text: Column) -> Column:
    """The unescaped value of a JSON member rationale; null if there is none, as written if it cannot be unescaped."""
    raw = F.nullif(F.regexp_extract(text, r'"rationale"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), raw, F.lit('"'))), "$", "string"), raw)


def flag_verdict(text: Column) -> Column:
    """The member passed of a response; false where there is none."""
    return F.lower(F.regexp_extract(text, r'(?i)"passed"\s*:\s*(true|false)', 1)) == "true"


def score(text: Column, low: float, high: float, whole: bool | None = None) -> Column:
    """The score of a response: a JSON member, else a named one, else a fraction of the scale, else the last number on it.

    Null if none of them is there. whole: rounded to whole numbers, by default if the scale has whole bounds.
    """
    whole = float(low).is_integer() and float(high).is_integer() if whole is None else whole
    top = bound_text(high).replace(".", r"\.")
    first = lambda pattern, *groups: F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])
    member = F.try_variant_get(json_object(text), "$.score", "double")
    named = first(rf'"score"\s*:\s*({_NUMBER})', 1)
    prose = rf"(?i)(?:overall|score|rating)\s*[=:]\s*({_NUMBER})\b|({_NUMBER})\s*/\s*{top}|\*\*({_NUMBER})\*\*\s*/\s*{top}"
    loose = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![\w.])({_NUMBER})\b"), F.lit(1)), lambda n: n.cast("double"))
    last = F.try_element_at(F.filter(loose, lambda n: n.between(low, high)), F.lit(-1))
    return whole_number(F.coalesce(member, named.cast("double"), first(prose, 1, 2, 3).cast("double"), last), whole)


def last_verdict(output: Column) -> Column:
    """The last flat JSON object with a score or a flag in the output of an agent; null if none is valid."""
    found = F.regexp_extract_all(output, F.lit(r'(\{[^{}]*"(?:score|passed)"\s*:[^{}]*\})'), F.lit(1))
    valid = F.filter(found, lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False)))
    return F.try_parse_json(F.try_element_at(valid, F.lit(-1)))


def agent_value(verdict: Column, is_flag: bool, whole: bool = False) -> Column:
    """The value of an agent's verdict as a double: flags as 0 and 1, a verdict of the other kind tolerated; null if it has neither."""
    passed = F.coalesce(F.try_variant_get(verdict, "$.passed", "boolean").cast("double"), (F.try_variant_get(verdict, "$.passed", "double") != 0).cast("double"))
    points = F.try_variant_get(verdict, "$.score", "double")
    return F.coalesce(passed, (points != 0).cast("double")) if is_flag else whole_number(F.coalesce(points, passed), whole)


def reasoning_text(members: Column) -> Column:
    """The reasons of a map of members: the first known name with text, else the longest text of more than 40 characters."""
    named = F.coalesce(*[F.when(F.length(F.trim(F.try_element_at(members, F.lit(k)))) > 0, F.try_element_at(members, F.lit(k))) for k in REASONING])
    others = F.filter(F.map_entries(members), lambda e: (e["key"] != "preferred") & (F.length(F.trim(e["value"])) > 40))
    sized = F.transform(others, lambda e, i: F.struct(F.length(e["value"]).alias("n"), (-i).alias("place"), e["value"].alias("value")))
    return F.coalesce(named, F.array_max(sized)["value"])


def first_value(members: Column, keys: list[str]) -> Column:
    """The first of some members that is not empty, '' if there is none."""
    return F.coalesce(*[F.nullif(F.try_element_at(members, F.lit(k)), F.lit("")) for k in keys], F.lit(""))
