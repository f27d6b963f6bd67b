"""Values that stop before their end.

A stack automaton follows what a value opens: strings, brackets, code fences, tags, table rows. What is
still open at the end, a broken character or a half escape, or a missing piece of a known structure shows a
cut. Where nothing is open and the last line has no terminator, the baseline decides: counts over the whole
corpus of how lists, signatures, decimals and paths end where they are certainly complete.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.session import stage

WHOLE, CUT = "whole", "cut"
#: Notes that a writer leaves behind a cut; what matters is the text in front of them.
MARK = re.compile(
    r"""(?:\s*(?:
        (?:\.\.\.|…)?\s*[\[(<{][^\[\](){}<>\n]{0,40}?(?:truncated|cut|clipped|omitted|elided|snip|more\ (?:char|line|byte|word|token)\w*|cont(?:inued|\.)?)[^\[\](){}<>\n]{0,40}[\])>}]
        |\[\s*(?:\.\.\.|…)\s*\]
        |-{2,}[^\n]{0,40}?(?:truncated|cut|clipped|omitted|elided|more)[^\n]{0,20}?-{2,}
        |\.\.\.|…|�+
    ))+\s*$""",
    re.X | re.I,
)
MARK_ENDS = frozenset("])>}-.…�")
TERMINATORS = frozenset(".!?。！？؟।۔")
CLOSERS = frozenset("\"')]}”’»」』）】`|>")
_INVISIBLE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            ​‌‍    ⁠　﻿"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BRACKET = re.compile(r"[{}\[\]()]")
_PAIR = {"}": "{", "]": "[", ")": "("}
_ESCAPE = re.compile(r"(?:(?<!\\)(?:\\\\)*\\|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?)$")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
_OPEN_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>\n]*|/)?$")
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "wbr", "source", "col"))
_PATH = re.compile(r"[\w.-]*/[\w./-]*")
_EXT = re.compile(r"/\w[\w-]*\.(\w+)(?=[\s,:;\"')\]]|\.\s)")
_DECIMAL = re.compile(r" \d+\.(?=\s)")
_LAST_DECIMAL = re.compile(r"(?<!\S)\d+\.$")
_RUN_LINE = re.compile(r"(?:PASS|FAIL|SKIP|ERROR) \S")
_RUN_END = re.compile(r"\d+ (?:passed|failed|skipped)\b.* in \d+\.\d+s$")
_DIGITS = re.compile(r"\d+")


def open_brackets(text: str) -> bool:
    """Whether a string or a bracket is still open at the end (JSON, code)."""
    rest = _STRING.sub("", text)
    if '"' in rest:
        return True
    stack: list[str] = []
    for mark in _BRACKET.findall(rest):
        if mark in _PAIR:
            if stack and stack[-1] == _PAIR[mark]:
                stack.pop()
        else:
            stack.append(mark)
    return bool(stack)


def open_markup(text: str) -> bool:
    """Whether a tag or an element is still open at the end."""
    if _OPEN_TAG.search(text):
        return True
    stack: list[str] = []
    for closing, name, empty in _TAG.findall(text):
        name = name.lower()
        if empty or name in _VOID:
            continue
        if not closing:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return bool(stack)


def _words(line: str) -> str:
    """The last two words of a line, every number as 0."""
    return _DIGITS.sub("0", " ".join(line.split()[-2:]).lower())


def _word_before(text: str, at: int) -> str:
    """The word that ends at a place."""
    words = [w for w in text[max(0, at - 60) : at].split() if w not in "*-+>|"]
    return _DIGITS.sub("0", words[-1].lower()) if words else ""


def judge(value: str) -> tuple[str, str]:
    """(verdict, key): whole, cut, or the baseline key that decides.

    Keys: "f ..." last words of a line without terminator, "f ^ ..." where they are the whole line; "b ..." the same of a list item; "n ..." the word
    before a number with a final point; "e ..." the extension of a path.
    """
    text = value.rstrip(_INVISIBLE)
    if not text:
        return WHOLE, ""
    if text[-1] in MARK_ENDS and (found := MARK.search(text, max(0, len(text) - 200))):
        if "�" in found[0]:
            return CUT, ""
        text = text[: found.start()].rstrip(_INVISIBLE)
        if not text:
            return WHOLE, ""
        verdict, _ = _inside(text)
        return (WHOLE if verdict == WHOLE else CUT), ""
    return _inside(text)


def _inside(text: str) -> tuple[str, str]:
    """Verdict on a value without its mark and its trailing white space."""
    # emoji and other symbols behind the last sentence
    while text and text[-1] > "\x7f" and unicodedata.category(text[-1]) in ("So", "Sk", "Mn", "Cf", "Me"):
        text = text[:-1].rstrip(_INVISIBLE)
    if not text:
        return WHOLE, ""
    if _ESCAPE.search(text, max(0, len(text) - 40)):
        return CUT, ""
    fenced = text.count("```")
    if fenced % 2:
        return CUT, ""
    start = text.rfind("\n\n") + 2 if "\n\n" in text else 0
    block = text[start:]
    head = block.lstrip()[:1]
    if text.lstrip()[:1] in ("{", "["):
        if text.lstrip()[0] == "{" or text.lstrip()[1:2] in ('"', "{", "["):
            return (CUT, "") if open_brackets(text) else (WHOLE, "") if text[-1] in "}]" else _tail(block, text)
    if head == "{":
        if open_brackets(block):
            return CUT, ""
        if text[-1] == "}":
            return WHOLE, ""
    if text.lstrip()[:1] == "<" and open_markup(text) or _OPEN_TAG.search(text[-80:]):
        return CUT, ""
    last = text[text.rfind("\n") + 1 :]
    if block.lstrip().startswith("def ") or text.startswith("def "):
        if open_brackets(last) and not last.lstrip().startswith("#"):
            return CUT, ""
        if not re.search(r"\n\s+(?!#)\S", block):
            return CUT, ""
        if last.lstrip().startswith("return") and last.endswith(")"):
            return WHOLE, ""
    if head == "|" and block.count("\n") >= 1 and last.startswith("|"):
        rows = block.split("\n")
        same = last.count("|") == rows[0].count("|") and last.endswith("|")
        return (WHOLE, "") if same and len(rows) > 2 else (CUT, "")
    if head == "|" and last.startswith("|"):
        return CUT, ""
    if _RUN_END.match(last):
        return WHOLE, ""
    if _RUN_LINE.match(last) or "\n" in block and _RUN_LINE.match(block.split("\n", 1)[0]):
        return CUT, ""
    if fenced and text.endswith("```"):
        return WHOLE, ""
    return _tail(block, text)


def _tail(block: str, text: str) -> tuple[str, str]:
    """Verdict by the last line of a value in which nothing is open."""
    last = text[text.rfind("\n") + 1 :].strip(_INVISIBLE)
    end = last[-1:]
    token = last.split()[-1] if last.split() else ""
    if end in TERMINATORS:
        if end == ".":
            if "/" in token and "://" not in token and "." not in token[:-1].rpartition("/")[2]:
                return CUT, ""
            if number := _LAST_DECIMAL.search(last):
                return "ask", "n " + _word_before(text, len(text) - len(number[0]))
        return WHOLE, ""
    if end in CLOSERS:
        if end == "'" or not open_brackets(last):
            inner = last.rstrip("\"'”’»」』")
            if end in "\"”’»」』" and inner and inner[-1] not in TERMINATORS and not inner[-1].isalnum() and inner[-1] not in CLOSERS:
                return CUT, ""
            return WHOLE, ""
        return CUT, ""
    if not (end.isalnum() or end == ":"):
        return CUT, ""
    if "/" in token and _PATH.fullmatch(token):
        stem, dot, ext = token.rpartition("/")[2].rpartition(".")
        if not dot or not stem or not ext:
            return CUT, ""
        others = last.split()[:-1]
        listed = not others or others[-1][-1] in ",:"
        return ("ask", "e " + ext) if listed else ("ask", "f " + _words(last))
    above = text[: text.rfind("\n")].rsplit("\n", 1)[-1].strip() if "\n" in text else ""
    if above and _PATH.fullmatch(above) and " " not in last:
        return CUT, ""
    if last[:2] in ("- ", "* ", "+ "):
        return "ask", "b " + _words(last)
    words = last.split()
    if len(words) <= 2:
        return "ask", "f ^ " + _words(last)
    if len(set(words)) * 5 <= len(words):  # the same few words over and over have no end to miss
        return WHOLE, ""
    return "ask", "f " + _words(last)


def _baseline(value: str, counts: Counter) -> None:
    """Ends that are certainly complete, because something follows them."""
    if "\n" in value:
        lines = value.split("\n")
        for line in lines[:-1]:
            if line[:2] in ("- ", "* ", "+ "):
                counts["b " + _words(line)] += 1
            elif 0 < len(line) < 40 and line[-1].isalnum() and line.count(" ") <= 1 and "/" not in line:
                counts["f ^ " + _words(line)] += 1
    for found in _DECIMAL.finditer(value):
        counts["n " + _word_before(value, found.start())] += 1
    for ext in _EXT.findall(value):
        counts["e " + ext] += 1


_SCHEMA = "what string, src_table string, source string, row_id long, field_name string, key string, n long"


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["what", "src_table", "source", "row_id", "field_name", "key", "n"]
    for batch in batches:
        out, counts, totals = [], {}, Counter()
        for src, source, row_id, field, value in batch.itertuples(index=False):
            verdict, key = judge(value)
            totals[(src, source)] += 1
            own = counts.setdefault((src, source), Counter())
            _baseline(value, own)
            if key[:2] == "f ":
                own[key] += 1
            if verdict != WHOLE:
                out.append((verdict, src, source, row_id, field, key, 1))
        out += [("count", src, source, None, None, k, n) for (src, source), own in counts.items() for k, n in own.items()]
        out += [("total", src, source, None, None, None, n) for (src, source), n in totals.items()]
        yield pd.DataFrame(out, columns=names).astype({"row_id": "Int64"})


def values(df: DataFrame, src_table: str, row_col: str, fields: list[str]) -> DataFrame:
    """Non-null values (src_table, source, row_id, field_name, value) of a table in one scan."""
    return df.select(
        F.lit(src_table).alias("src_table"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col(row_col).cast("long").alias("row_id"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])),
    ).filter("value is not null")


def probe(rows: DataFrame) -> DataFrame:
    """One pass over the values: cut rows, rows that the baseline decides, and the counts of the baseline."""
    return stage(rows.mapInPandas(_probe, _SCHEMA), "truncation")


def cut_values(probed: DataFrame, end_share: float = 0.01, value_share: float = 0.002, inner_share: float = 0.0005, least: int = 2) -> DataFrame:
    """Cut values (src_table, source, row_id, field_name).

    An end without terminator is complete if it makes up at least `end_share` of all such ends (signatures,
    lead-ins) or, where it is the whole line, `value_share` (fixed answers). The last words of a list item,
    the word before a number with a final point, and the extension of a path are complete if they are seen
    `least` times, and in `inner_share` of all cases of their kind, where something follows them. All shares are
    those within the source of the value; a source with fewer than least / inner_share counts of a kind, too few
    for its rarest complete ends to show, is measured by the whole corpus. Null, empty
    and invisible values are never cut; repeated rows count each for themselves.
    """
    place = ["src_table", "source"]
    share = F.when(F.col("key").startswith("f ^ "), value_share).when(F.col("kind") == "f", end_share).otherwise(inner_share)
    usual = (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))
    kind = F.left("key", F.lit(1))
    own = probed.filter("what = 'count'").groupBy(*place, "key").agg(F.sum("n").alias("n")).withColumn("kind", kind)
    sizes = own.groupBy(*place, "kind").agg(F.sum("n").alias("total")).filter(F.col("total") >= least / inner_share)
    known = own.join(sizes, [*place, "kind"]).filter(usual).select(*place, "key")
    corpus = own.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    known_all = corpus.join(corpus.groupBy("kind").agg(F.sum("n").alias("total")), "kind").filter(usual).select("key")
    columns = [*place, "row_id", "field_name"]
    asked = probed.filter("what = 'ask'").withColumn("kind", kind)
    by_source = asked.join(sizes, [*place, "kind"], "left_semi").join(known, [*place, "key"], "left_anti")
    by_corpus = asked.join(sizes, [*place, "kind"], "left_anti").join(known_all, "key", "left_anti")
    return probed.filter("what = 'cut'").select(*columns).unionByName(by_source.select(*columns)).unionByName(by_corpus.select(*columns))


def rates(probed: DataFrame, cut: DataFrame) -> DataFrame:
    """Values, cut values and their share for each source."""
    all_of = probed.filter("what = 'total'").groupBy("src_table", "source").agg(F.sum("n").alias("n_values"))
    bad = cut.groupBy("src_table", "source").agg(F.count("*").alias("n_cut"))
    return all_of.join(bad, ["src_table", "source"], "left").select(
        "src_table", "source", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_values")).alias("share_cut")
    )
