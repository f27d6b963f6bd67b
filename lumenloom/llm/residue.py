"""Template residue, filler, error pages and script notices in place of content.

Normalised lines are counted for each host (the source of a document); lines that recur there are page
furniture, and so are lines that the whole corpus knows beside notices only. Of a record with evidence these
lines are subtracted, and what is left decides: an unfilled placeholder outside quotes, or nothing but error,
filler or script evidence. Text that quotes such things, or holds other sentences beside them, is content.
Evidence is general: status codes with their standard phrases, the grammar of failure, exceptions of
programs, template syntax, repetition and imitations of the classical filler passage. What a site writes
beside its notices is not listed anywhere; the counts find it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from http import HTTPStatus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.session import stage

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
_MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1>|</?[a-z][a-z0-9]*(?:\s[^<>\n]*)?/?>", re.S)
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\s*\n\s*|\s+\|\s+")

#: Placeholders of common template languages, and values that failed to be filled in (fixed patterns).
PLACEHOLDER = re.compile(
    r"""\{\{[^{}\n]{0,80}\}\}|\{%[^{}%\n]{0,80}%\}|<%[^<>%\n]{0,80}%>|\$\{[^{}\n]{1,60}\}|\#\{[^{}\n]{1,60}\}
    |@@\w{1,40}@@|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|(?<![\w%])%(?:\([\w.\- ]{1,40}\))?[sdf](?!\w)
    |(?<![\w{"])\{(?:\d{1,2}|[A-Za-z_][\w.\- ]{0,40})\}(?![\w}])|(?<!\w)\$[A-Z][A-Z0-9_]{1,40}\$|(?<!\w)__[A-Z](?:[A-Z0-9_]*[A-Z0-9])?__(?!\w)|%%\w{1,40}%%
    |<[A-Z][A-Z0-9_ -]{2,40}>|<(?:your|insert|enter|the)\s[^<>\n]{1,50}>
    |\[(?:insert|your|enter|add|fill\ in)\b[^\[\]\n]{1,50}\]|\[[\w \-]{1,40}:\s*(?:TBD|TODO|N/?A|\?+|xxx+)\]|\[[\w \-]{1,40}\shere\]|\[(?:TBD|TODO)\]
    |(?<!\w)(?:X{4,}|TBD|undefined|NaN|\[object\ Object\])(?!\w)""",
    re.X | re.I,
)
#: What the pattern finds only because it ignores letter case: tags, names and words.
_CASELESS_ONLY = re.compile(r"<[a-z][a-z0-9_ -]*>|__[a-z]\w*__|x{4,}|tbd|Undefined|UNDEFINED|nan|NAN|Nan|Tbd|\$[a-z]\w*\$")

#: Evidence by the words it cannot do without: a rule is tried only on texts that hold one of its words.
_SCRIPT = r"(?:java\s?script|\bjs\b|(?:client-side\s)?\bscript(?:s|ing)\b)"
#: Reason phrases of the standard, and those of its earlier editions (fixed values).
_REASONS = sorted({s.phrase.lower() for s in HTTPStatus if s >= 400} | {"unprocessable entity", "payload too large", "request entity too large", "request-uri too long", "unavailable for legal reasons"})
_REASON = "|".join(re.escape(r).replace(r"\ ", r"[\s-]+").replace("timeout", "time-?out") for r in _REASONS)
_THING = r"\b(?:service|site|page|server|host|name|link|session|connection|request|resource|document|file|folder|content|report|view|account|token)s?\b"
_RULES = (
    ("script", "javascript java script scripts scripting js", rf"""
        {_SCRIPT}[^.]{{0,40}}\b(?:required|disabled|blocked|off|must|needed|allowed|enabled|switched)\b
        |\b(?:enable|turn\s+on|allow|activate|switch\s+on|without|needs?|requires?|rely\s+on|blocks?|active[nrz]?|aktivieren|activer|activez|activar|habilite|activa)\b[^.]{{0,50}}{_SCRIPT}
        |\bjs\s+is\b|{_SCRIPT}\s*(?:を|が|有|启|啟)"""),
    ("error", "error fehler erreur code status http", r"""
        \b(?:error|fehler|erreur|status|http|code)\W{0,3}(?:code\W{0,2})?[45]\d\d\b|\b(?:internal|server|sql|database|application|network)\s+error\b
        |\binterner\s+fehler\b|\bfehler\.\s+interner\b|\berror\s+interno\b|\berreur\s+interne\b"""),
    ("error", " ".join(sorted({r.replace("-", " ").split()[-1] for r in _REASONS} | {"time", "timeout", "out", "unavailable"})), rf"""
        \b[45]\d\d\W{{1,3}}(?:{_REASON})\b|^(?:{_REASON})\W*$|\b(?:{_REASON})\W{{0,3}}[45]\d\d\b
        |\b(?:bad\s+gateway|gateway\s+time-?out|forbidden|not\s+found|too\s+many\s+requests|service\s+(?:temporarily\s+)?unavailable)\b"""),
    ("error", "denied permission human stopped blocked rejected refused browser", r"""
        \baccess\s+(?:was\s+|is\s+)?denied\b|\bnot\s+have\s+permission\b|\bverify\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human\b|\b(?:testing|checking|verifying)\s+your\s+browser\b
        |\brequest\s+(?:was|has\s+been)\s+(?:stopped|blocked|denied|rejected|refused)\b"""),
    ("error", "unavailable available valid exists exist expired ended timed reset refused closed lost interrupted resolved reached removed server moved", rf"""
        {_THING}[^.]{{0,60}}\b(?:unavailable|no\s+longer\s+(?:available|valid|exists?)|(?:has|have)\s+(?:expired|ended|timed\s+out|been\s+(?:moved|removed))
        |(?:can\s?not|could\s+not|can['’]t)\s+be\s+(?:resolved|reached|found|loaded)|(?:was|were|been)\s+(?:reset|refused|closed|lost|interrupted)|not\s+on\s+this\s+server)\b"""),
    ("error", "oops wrong maintenance page traceback", r"\boops\b|\bsomething\s+went\s+wrong\b|\bdown\s+for\s+maintenance\b|\bno\s+such\s+page\b|^traceback\b"),
    ("error", "could cannot can unable failed possible", r"""
        \b(?:could\s+not|can\s?not|can['’]t|unable\s+to|failed\s+to|not\s+possible\s+to)\s+(?:be\s+)?(?:load|open|show|find|fetch|render|display|reach|connect|retrieve|respond|process|complete)(?:ed|n)?\b"""),
    ("error", "answer respond reply response", r"\bdid\s+not\s+(?:answer|respond|reply)\b|\bno\s+(?:reply|response|answer)\s+from\b"),
    ("error", "introuvable gefunden encontrada encontrado existe disponible indisponible erreichbar", r"""
        \bintrouvable\b|\bnicht\s+(?:gefunden|erreichbar)\b|\bno\s+encontrad[oa]\b|\bn['’]existe\s+plus\b|\bno\s+disponible\b|\bindisponible\b"""),
    ("filler", "ipsum goes sample something add replace todo coming content left draft texto relleno contenu hier item title section heading bullet chapter paragraph text short body description placeholder intentionally n na", r"""
        \blorem\s+ipsum\b|\byour\s+(?:text|content|title)\s+goes\s+here\b|\bsample\s+(?:content|text)\b.*\blayout\b|\bwrite\s+something\s+about\b
        |^add\s+an?\s+(?:short\s+)?(?:description|title|summary)\b|\breplace\s+this\s+(?:paragraph|text|sentence|line)\b|^todo\b|\bcoming\s+soon\b|^content\s+to\s+follow\b
        |\b(?:left|intentionally)\s+(?:left\s+)?(?:empty|blank)\b|^draft,?\s+text\s+pending\b|\btexto\s+de\s+relleno\b|^contenu\s+à\s+venir\b|\bhier\s+steht\s+später\b
        |^(?:(?:item|title|section|heading|bullet|chapter|paragraph)\s+\d+)\W*$|^(?:body\s+text|short\s+text|description|placeholder\s+(?:copy|text))\W*$|^(?:n/?a\W*)+$"""),
)
RULES = tuple((kind, frozenset(words.split()), re.compile(pattern, re.X | re.I)) for kind, words, pattern in _RULES)
_LATIN = re.compile(r"[a-zà-ÿ]+")
_NEEDED = frozenset().union(*(words for _, words, _ in RULES))
_DIGIT, _NUMBER = re.compile(r"\d"), re.compile(r"\d+")
#: An exception of a program and the frames above it, in the notation of stack traces.
_TRACE = re.compile(r"^(?:\w+\.)*\w*(?:Error|Exception)\b\s*:|^File\s.{0,200},\s*line\s+\d+|^\s*at\s+\S+\(.*:\d+\)$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: The classical filler passage of typesetters (fixed values); its imitations change the ends of its words.
_LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco "
    "laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum"
)
_STEMS = frozenset(w[:3] for w in _LOREM.split() if len(w) > 3)
_PLAIN = re.compile(r"[^\W\d_]+(?:[ ,]+[^\W\d_]+)*[.!?,]*")
_SIGNS = re.compile(r"\{\{|\{%|<%|\$\{|#\{|@@|\[\[|<<|%[sdf(%]|\{\w|\$[A-Z]|__[A-Z]|<[A-Z]|<(?:your|insert|enter|the) |\[[A-Za-z]|XXXX|[Tt][Bb][Dd]|undefined|NaN")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")


def normal(segment: str) -> str:
    """A line for counting: lower case, numbers and request ids levelled, words of a menu in one order."""
    text = segment.lower()
    if _DIGIT.search(text):  # ids have digits too
        text = _NUMBER.sub("0", _HEX.sub("#", text))
    words = text.split()
    return " ".join(sorted(words) if len(words) <= 12 and segment.istitle() else words)


def counted(segment: str) -> str:
    """A normalised line as it is counted and joined: a long one by a hash of 128 bits."""
    line = normal(segment)
    return line if len(line) <= 200 else hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=16).hexdigest()


def imitation(words: list[str]) -> float:
    """Share of words that begin as words of the filler passage do; 0 for fewer than three such words."""
    hits = sum([w[:3] in _STEMS and len(w) > 3 for w in words])
    return hits / len(words) if hits >= 3 else 0.0


def babble(words: list[str]) -> bool:
    """The same few words again and again."""
    return len(words) >= 6 and len(set(words)) * 3 <= len(words)


def label(segment: str) -> bool:
    """A title, a menu, a year, a number or an id: no sentence of its own."""
    words = _WORD.findall(_HEX.sub(" ", segment))
    small = sum(w[0].islower() for w in words)
    return not words or small <= 1 and len(words) <= 14 and not re.search(r"[/_{}|=]", segment) and all(ord(c) < 0x2E80 for c in segment)


def kinds(parts: list[str]) -> list[str]:
    """error, script, filler, label or content for each line of a text; quoted passages are no evidence.

    A text without evidence is all content.
    """
    bare = [_QUOTED.sub(" q ", " ".join(p.split())) for p in parts]
    out: list[str] = []
    clear = False
    for segment in bare:
        low = segment.lower()
        latin = _LATIN.findall(low)
        words = latin if low.isascii() else _WORD.findall(low)
        named = _NEEDED.intersection(latin)
        found = next((kind for kind, needs, pattern in RULES if not needs.isdisjoint(named) and pattern.search(segment)), None) if named else None
        if found is None and (":" in segment or "line" in low) and _TRACE.search(segment):
            found = "error"
        if len(words) >= 3:
            imitated = imitation(words) >= 0.5
            if (imitated or babble(words)) and _PLAIN.fullmatch(segment):
                clear = clear or imitated
                found = found or "filler"
        out.append(found or "content")
    if not any(k != "content" for k in out):
        return out
    out = ["label" if k == "content" and label(segment) else k for k, segment in zip(out, bare)]
    if clear:  # beside clear filler a line of its words is more of it
        known = {w.lower() for k, segment in enumerate(bare) if out[k] == "filler" for w in _WORD.findall(segment)}
        for k, segment in enumerate(bare):
            if out[k] == "content" and _PLAIN.fullmatch(segment):
                words = [w.lower() for w in _WORD.findall(segment)]
                if sum(w in known or len(w) > 3 and w[:3] in _STEMS for w in words) * 2 >= len(words):
                    out[k] = "filler"
    return out


EVIDENCE = ("error", "script", "filler")


def placeholder(text: str) -> bool:
    """An unfilled placeholder or a failed value outside quotes and code."""
    if not _SIGNS.search(text):
        return False
    bare = _QUOTED.sub(" ", _FENCE.sub(" ", text))
    for found in PLACEHOLDER.finditer(bare):
        if not _CASELESS_ONLY.fullmatch(found[0]) or found[0].lower().startswith(("<your ", "<insert ", "<enter ", "<the ")):
            return True
    return False


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, without its markup."""
    if "<" in text and ">" in text:
        text = html.unescape(_MARKUP.sub("\n", text))
    return [s.strip() for s in _SPLIT.split(text) if s and s.strip(" \t\r\n.|​﻿\xa0")]


_SCHEMA = "what string, doc_id long, source string, line string, kind string, n long"


def _inspect(batches: Iterator[pd.DataFrame], notice: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, counts = [], Counter()
        for doc_id, source, text in batch.itertuples(index=False):
            parts = segments(text)
            lines = [counted(p) for p in parts]
            counts.update((source, line) for line in set(lines))
            counts[(source, "")] += 1
            if placeholder(text):
                out.append(("case", doc_id, source, "", "placeholder", 1))
                continue
            found = kinds(parts)
            proof = next((k for k in found if k in EVIDENCE), None)
            if proof:
                # whether it is short enough for its lines to be counted as those of a notice
                out.append(("open", doc_id, source, "", proof, int(found.count("content") <= notice)))
                out += [("open", doc_id, source, line, k, int(found.count("content") <= notice)) for line, k in zip(lines, found) if k not in EVIDENCE]
        out += [("count", None, source, line, None, n) for (source, line), n in counts.items()]
        yield pd.DataFrame(out, columns=["what", "doc_id", "source", "line", "kind", "n"]).astype({"doc_id": "Int64"})


def residue(documents: DataFrame, share: float = 0.001, least: int = 4, beside: float = 0.8, notice: int = 3) -> DataFrame:
    """Documents (doc_id, kind) that hold residue, filler, an error page or a script notice instead of content.

    A line is furniture of its host if it stands in at least `least` and a `share` of the host's documents; on
    hosts too small to show it, if it stands in `least` documents of the corpus and in a share of `beside` of
    them next to evidence and at most `notice` lines with sentences. From every document with evidence these
    lines are taken away; it is a case if what is left beside the evidence has no sentence (titles, menus,
    numbers). An unfilled placeholder outside quotes and code is a case wherever it stands. Null, empty and
    invisible texts are no cases. One pass over the texts; the lines of documents with evidence are joined
    with the counts. Repeated rows give repeated results.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")
    ).filter("text is not null")
    seen = stage(rows.mapInPandas(lambda batches: _inspect(batches, notice), _SCHEMA), "residue")
    asked = seen.filter("what = 'open'").select("doc_id", "source", "line", "kind", "n")
    counted_lines = seen.filter("what = 'count' and line != ''").select("source", "line", "n")
    sizes = seen.filter("what = 'count' and line = ''").groupBy("source").agg(F.sum("n").alias("docs"))
    usual = counted_lines.groupBy("source", "line").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).join(sizes, "source").filter(F.col("n") >= share * F.col("docs")).select("source", "line", F.lit(True).alias("usual"))
    # a line counts once for a document
    notices = asked.filter("kind = 'content' and n = 1").groupBy("line").agg(F.count_distinct("doc_id").alias("near"))
    corpus = counted_lines.join(notices.filter(f"near >= {least} * {beside}"), "line").groupBy("line").agg(F.sum("n").alias("n"), F.first("near").alias("near"))
    known = corpus.filter(f"n >= {least} and near >= {beside} * n").select("line", F.lit(True).alias("known"))
    left = asked.join(usual, ["source", "line"], "left").join(known, "line", "left").filter("usual is null and known is null")
    judged = left.groupBy("doc_id").agg(F.max(F.when(F.col("line") == "", F.col("kind"))).alias("kind"), F.bool_or(F.col("kind") == "content").alias("content"))
    return seen.filter("what = 'case'").select("doc_id", "kind").unionByName(judged.filter("not content").select("doc_id", "kind"))
