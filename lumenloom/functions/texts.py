"""Texts of tool inputs, prompts and differences."""

from __future__ import annotations

import difflib
import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingField(KeyError):
    """A template needs a field that the input does not have."""


def fill(template: str, given: dict[str, object]) -> str:
    """A template with {field} and optional {field?} filled from the input of a case, runs of blanks as one."""

    def value(found: re.Match[str]) -> str:
        name = found[1].removesuffix("?")
        if given.get(name) is None:
            if found[1].endswith("?"):
                return ""
            raise MissingField(name)
        return str(given[name])

    return re.sub(r"[ \t]+", " ", re.sub(r"\{([^}]+)\}", value, template)).strip()


def filled(template: str, columns: dict[str, Column]) -> Column:
    """The same over columns: null where a required field is null, an unknown name is an error on the driver."""
    parts, at = [], 0
    for found in re.finditer(r"\{([^}]+)\}", template):
        name = found[1].removesuffix("?")
        if name not in columns and not found[1].endswith("?"):
            raise MissingField(name)
        value = columns[name].cast("string") if name in columns else F.lit("")
        parts += [F.lit(template[at : found.start()]), F.coalesce(value, F.lit("")) if found[1].endswith("?") else value]
        at = found.end()
    return F.trim(F.regexp_replace(F.concat(*parts, F.lit(template[at:])), r"[ \t]+", " "))


def capped(value: object, cap: int) -> object:
    """A JSON object whose texts, at any depth of objects, are cut at cap, with notes of the cut ones."""
    if not isinstance(value, dict):
        return value
    out: dict[str, object] = {}
    notes: dict[str, object] = {}
    for name, member in value.items():
        long = isinstance(member, str) and len(member) > cap
        out[name] = member[:cap] + "[truncated]" if long else capped(member, cap)
        if long:
            notes[name] = {"truncated": True, "original_length": len(member)}
    return out | {"_truncated": notes} if notes else out


def cap_values(text: Column, cap: int) -> Column:
    """JSON text of an object with its texts cut; anything else stays as it is. Only rows longer than cap reach Python."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: object) -> object:
            try:
                value = json.loads(t) if isinstance(t, str) else None
            except (ValueError, RecursionError):
                return t
            return json.dumps(capped(value, cap), ensure_ascii=False) if isinstance(value, dict) else t

        return texts.map(one)

    return F.when(F.length(text) > cap, cut(F.when(F.length(text) > cap, text))).otherwise(text)


def user_text(content: Column) -> Column:
    """The text of a message's content (variant): a bare text, or the text parts with a blank line between them."""
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    texts = F.filter(F.transform(parts, lambda b: F.trim(F.try_variant_get(b, "$.text", "string"))), lambda t: F.length(t) > 0)
    bare = F.when(F.schema_of_variant(content) == "STRING", F.trim(F.try_variant_get(content, "$", "string")))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(F.array_join(texts, "\n\n"), F.lit("")), F.lit(""))


def output_blocks(files: Column) -> Column:
    """All files of a map as headed blocks, by name; '' if there are none."""
    blocks = F.transform(F.array_sort(F.map_entries(files)), lambda e: F.concat(F.lit("\n### "), e["key"], F.lit("\n\n"), e["value"], F.lit("\n")))
    return F.coalesce(F.array_join(blocks, ""), F.lit(""))


def word_marks(old: str, new: str) -> tuple[str, str]:
    """Both lines with deleted and inserted words marked."""
    a, b = re.findall(r"\s+|\S+", old), re.findall(r"\s+|\S+", new)
    left, right = [], []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        gone, come = html.escape("".join(a[i:j])), html.escape("".join(b[k:m]))
        left.append(gone if kind == "equal" or not gone else f"<del>{gone}</del>")
        right.append(come if kind == "equal" or not come else f"<ins>{come}</ins>")
    return "".join(left), "".join(right)


def side_by_side(old: str, new: str, context: int = 3) -> list[tuple[str, str | None, str | None]]:
    """(kind, old line, new line) of what differs, with lines of context around it; a gap stands for what is left out."""
    a, b = old.splitlines(), new.splitlines()
    out: list[tuple[str, str | None, str | None]] = []
    for number, group in enumerate(difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context)):
        if number:
            out.append(("gap", None, None))
        for kind, i, j, k, m in group:
            for step in range(max(j - i, m - k)):
                out.append((kind, a[i + step] if i + step < j else None, b[k + step] if k + step < m else None))
    return out


_ROW = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))


@F.pandas_udf(_ROW)
def line_differences(old: pd.Series, new: pd.Series) -> pd.Series:
    """side_by_side of each pair of texts; null counts as empty."""
    text = lambda t: t if isinstance(t, str) else ""
    return pd.Series([[{"kind": k, "old": a, "new": b} for k, a, b in side_by_side(text(x), text(y))] for x, y in zip(old, new)])


def json_array(text: str) -> list | None:
    """The JSON array of a response: fenced, behind prose, or cut off, of which the whole elements are kept; None if there is none."""
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.S)
    for body in ([fence[1]] if fence else []) + [text]:
        at = body.find("[")
        while at >= 0:
            reader, place, found = json.JSONDecoder(strict=False), at + 1, []
            while True:
                rest = re.compile(r"[\s,]*").match(body, place).end()
                if body[rest : rest + 1] == "]":
                    return found
                try:
                    element, place = reader.raw_decode(body, rest)
                except (ValueError, RecursionError):
                    break
                found.append(element)
            if found and all(isinstance(e, dict) for e in found):
                return found
            at = body.find("[", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_array(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if not isinstance(t, str) or (a := json_array(t)) is None else json.dumps(a, ensure_ascii=False))
