"""What a shell command reads and runs. Quoting has no built-in, so these are Arrow-batched functions."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHELLS = {"bash", "sh", "zsh", "dash"}
#: Options that take a value: of the readers a number, of sed a program or a file of one.
_COUNTED = {"-n", "--lines", "-c", "--bytes"}
_INTERPRETERS = {"python", "python3", "bash", "sh", "node", "ruby", "perl"}


def commands(text: str) -> list[list[str]]:
    """Simple commands of a line as words, without redirections; [] if the quoting is broken."""
    try:
        lexer = shlex.shlex(text, posix=True, punctuation_chars="|&;<>")
        lexer.whitespace_split = True
        tokens = list(lexer)
    except ValueError:
        return []
    out: list[list[str]] = [[]]
    skip = False
    for token in tokens:
        if skip:
            skip = False
        elif set(token) <= set("|&;"):
            out.append([])
        elif set(token) <= set("<>&"):
            skip = True
            if out[-1] and out[-1][-1].isdigit():
                out[-1].pop()
        else:
            out[-1].append(token)
    return [c for c in out if c]


def _plain_words(text: str) -> list[str]:
    """Words of one simple command without its redirections; [] for pipelines, lists, substitutions and broken quoting."""
    try:
        words = shlex.split(text)
        if words and words[0].rpartition("/")[2] in _SHELLS:
            if not any(w.startswith("-") and "c" in w for w in words[1:-1]):
                return []
            words = shlex.split(words[-1])
    except ValueError:
        return []
    if any("$(" in w or "`" in w or w.startswith(("<(", ">(")) for w in words):
        return []
    kept, skip = [], False
    for w in words:
        arrow = re.match(r"(?:\d*|&)(?:>>?|<<?<?)(?:&\d+|&-)?", w)
        if skip:
            skip = False
        elif arrow and arrow[0]:
            skip = arrow[0] == w and "&" not in w[1:]  # the target is the next word
        else:
            kept.append(w)
    return [] if any(c in w for w in kept for c in "|;&") else kept


def read_paths(text: str) -> list[str]:
    """Files that a simple cat, sed, head or tail reads."""
    name, *rest = _plain_words(text) or [""]
    name = name.rpartition("/")[2]
    if name == "cat":
        return [w for w in rest if w and not w.startswith("-")]
    if name not in ("sed", "head", "tail"):
        return []
    found, words, program = [], iter(rest), name != "sed"
    for w in words:
        if name == "sed" and w in ("-e", "--expression", "-f", "--file"):
            value = next(words, None)
            program = True
            if w in ("-f", "--file") and value is not None:
                found.append(value)
        elif name != "sed" and w in _COUNTED:
            next(words, None)
        elif w.startswith("-"):
            continue
        elif not program:
            program = True
        else:
            found.append(w)
    return found


def scripts(text: str) -> list[str]:
    """Script files that the commands run."""
    found = []
    for name, *rest in commands(text):
        if name.rpartition("/")[2] in _INTERPRETERS:
            plain = [w for w in rest if not w.startswith("-")]
            if plain and "." in plain[0]:
                found.append(plain[0])
        elif "/" in name and "." in name.rpartition("/")[2]:
            found.append(name)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def command_read_paths(text: pd.Series) -> pd.Series:
    return text.map(lambda t: read_paths(t) if isinstance(t, str) else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def command_scripts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: scripts(t) if isinstance(t, str) else [])
