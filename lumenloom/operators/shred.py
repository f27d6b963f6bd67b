"""Nested JSON records to related flat tables by columnar shredding.

Every leaf path becomes a column with definition levels, every repeated path a sequence of repetition and
definition levels. A leaf below a repeated path has one entry for each of its slots, so the flat table of a
repeated ancestor is read off the level sequences alone: a repetition level says which position moves on, a
definition level says whether anything stands there. Columns are found while reading; a path first seen late
gets the levels that its ancestor had so far.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Path = tuple[str, ...]


class Level:
    """A repeated ancestor: its level sequence, its leaf columns and the repeated paths below it."""

    def __init__(self, path: Path, rep: int, defined: int) -> None:
        self.path, self.rep, self.defined = path, rep, defined
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.leaves: dict[Path, tuple[list[int], list[object]]] = {}
        self.lists: dict[Path, Level] = {}

    def missing(self, rep: int, depth: int) -> None:
        """No element: the list, or something above it, ends at this definition level."""
        self.reps.append(rep)
        self.defs.append(depth)
        for defs, values in self.leaves.values():
            defs.append(depth)
            values.append(None)
        for below in self.lists.values():
            below.missing(rep, depth)

    def element(self, value: object, rep: int, keep: Callable[[Path], bool]) -> None:
        """One non-null element."""
        leaves: dict[Path, tuple[int, object]] = {}
        lists: dict[Path, tuple[int, list]] = {}
        self._flatten(value, (), self.defined, leaves, lists)
        seen = len(self.reps)
        for path, (depth, scalar) in leaves.items():
            if path not in self.leaves:
                if scalar is None or not keep(self.path + path):
                    continue
                self.leaves[path] = (self.defs.copy(), [None] * seen)
            defs, values = self.leaves[path]
            defs.append(depth)
            values.append(scalar)
        for path, (depth, items) in lists.items():
            if path not in self.lists:
                if not items or not keep((*self.path, *path, "[]")):
                    continue
                below = self.lists[path] = Level((*self.path, *path, "[]"), self.rep + 1, depth + 2)
                for r, d in zip(self.reps, self.defs):
                    below.missing(r, d)
            below = self.lists[path]
            if not items:
                below.missing(rep, depth)
            for k, item in enumerate(items):
                at = rep if k == 0 else below.rep
                if item is None:
                    below.missing(at, depth + 1)
                else:
                    below.element(item, at, keep)
        self.reps.append(rep)
        self.defs.append(self.defined)
        for path, (defs, values) in self.leaves.items():
            if len(values) == seen:
                defs.append(self.defined)
                values.append(None)
        for path, below in self.lists.items():
            if path not in lists:
                below.missing(rep, self.defined)

    def _flatten(self, value: object, path: Path, depth: int, leaves: dict, lists: dict) -> None:
        if isinstance(value, dict):
            for name, member in value.items():
                if member is None:
                    leaves[(*path, name)] = (depth, None)
                else:
                    self._flatten(member, (*path, name), depth + 1, leaves, lists)
        elif isinstance(value, list):
            lists[path] = (depth, value)
        else:
            leaves[path] = (depth, value)

    def walk(self) -> Iterator[Level]:
        yield self
        for below in self.lists.values():
            yield from below.walk()

    def rows(self) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(record, positions, slot) of every element, from the level sequence alone."""
        record, at = -1, [0] * (self.rep + 1)
        for slot, (rep, depth) in enumerate(zip(self.reps, self.defs)):
            if rep == 0:
                record += 1
                at = [0] * (self.rep + 1)
            else:
                at[rep] += 1
                at[rep + 1 :] = [0] * (self.rep - rep)
            if depth >= self.defined:
                yield record, tuple(at[1:]), slot


def shred(records: list[object], keep: Callable[[Path], bool] = lambda path: True) -> Level:
    """Levels of the records; None is a record without content. keep: which leaf and list paths to store."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # as deep as the JSON reader goes
    root = Level((), 0, 1)
    for record in records:
        if record is None:
            root.missing(0, 0)
        else:
            root.element(record, 0, keep)
    return root


def _blocks(content: object, whole: bool = False) -> object:
    """Content as a list of objects: a string or a single object stands for an element 0.

    whole: numbers and booleans in place of content, and arrays in place of a block, stay as they are.
    """
    if isinstance(content, (str, dict)):
        content = [content]
    if not isinstance(content, list):
        return content if whole else None
    out: list[object] = []
    for block in content:
        if block is None:
            out.append(None)
        elif isinstance(block, str):
            out.append({"type": "text", "text": block, "_bare": True})
        elif isinstance(block, dict):
            out.append(block | {"content": _blocks(block["content"], whole)} if "content" in block else block)
        else:
            out.append(block if whole and isinstance(block, list) else {"_value": json.dumps(block)})
    return out


def _parsed(line: object) -> dict | None:
    """A transcript line; None if it is not a JSON object."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
    try:
        record = json.loads(line) if isinstance(line, str) else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def whole_record(line: object) -> dict | None:
    """A transcript line with all its members, its message decoded and the content as blocks; None as in _parsed.

    A message text that is no JSON object stays a text.
    """
    record = _parsed(line)
    message = record.get("message") if record is not None else None
    if isinstance(message, str):
        try:
            message = json.loads(message)
        except (ValueError, RecursionError):
            return record
    if not isinstance(message, dict):
        return record
    if "content" in message:
        message = message | {"content": _blocks(message["content"], True)}
    return record | {"message": message}


def transcript_record(line: object) -> dict | None:
    """The parts of a transcript line that the child tables need; None if it is not a JSON object."""
    record = _parsed(line)
    if record is None:
        return None
    message = record.get("message")
    if isinstance(message, str):
        try:
            message = json.loads(message)
        except (ValueError, RecursionError):
            message = None
    out: dict[str, object] = {}
    if isinstance(record.get("usage"), dict):
        out["usage"] = record["usage"]
    if isinstance(message, dict):
        out["message"] = {
            "content": _blocks(message.get("content")),
            "usage": message["usage"] if isinstance(message.get("usage"), dict) else None,
        }
    return out


def _is_block_path(path: Path) -> bool:
    return path[:2] == ("message", "content") and all(p in ("content", "[]") for p in path[2:])


def _child_keep(path: Path) -> bool:
    if path[-1] == "[]":
        return _is_block_path(path)
    return path[0] == "usage" or path[:2] == ("message", "usage") or path[-1] == "type" and _is_block_path(path[:-1])


CHILD_SCHEMA = "line_id long, child string, node_path string, parent_path string, tag string"


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["line_id"].to_numpy()
        root = shred([transcript_record(line) for line in batch["line"]], _child_keep)
        out: list[tuple] = []
        for path, (_, values) in root.leaves.items():
            name = path[1:] if path[0] == "usage" else path[2:]
            if "usage" not in path[:2] or not name:
                continue
            for record, _, slot in root.rows():
                value = values[slot]
                if value is not None and not isinstance(value, (str, bool)):
                    out.append((ids[record], "usage", ".".join(name), ".".join(name[:-1]), ""))
        for level in root.walk():
            if level.rep == 0:
                continue
            tags = level.leaves.get(("type",), (None, None))[1]
            for record, at, slot in level.rows():
                places = [str(k) for k in at]
                tag = tags[slot] if tags else None
                out.append((ids[record], "block", ".".join(places), ".".join(places[:-1]), tag if isinstance(tag, str) else ""))
        yield pd.DataFrame(out, columns=["line_id", "child", "node_path", "parent_path", "tag"])


def transcript_children(lines: DataFrame) -> DataFrame:
    """Child rows (CHILD_SCHEMA) of lines (line_id, line): blocks of any depth, and usage counters.

    Lines that are null, broken or no JSON object have no children; rejects() names each of them with its
    reason, lines too deep for the JSON reader among them (paths of all blocks of a line of n nested ones are n
    squared long). One pass without a shuffle; a line is shredded where it is read.
    """
    return lines.select("line_id", "line").mapInPandas(_children, CHILD_SCHEMA)


LEAF_SCHEMA = "line_id long, ancestor string, node_path string, leaf string, def_level int, value string"


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["line_id"].to_numpy()
        root = shred([whole_record(line) for line in batch["line"]])
        out: list[tuple] = []
        for level in root.walk():
            name = ".".join(level.path)
            for record, at, slot in level.rows():
                place = ".".join(map(str, at))
                for path, (defs, values) in level.leaves.items():
                    value = values[slot]
                    if value is not None:
                        out.append((ids[record], name, place, ".".join(path), defs[slot], value if isinstance(value, str) else json.dumps(value)))
        yield pd.DataFrame(out, columns=["line_id", "ancestor", "node_path", "leaf", "def_level", "value"])


def transcript_leaves(lines: DataFrame) -> DataFrame:
    """Every leaf value of the lines that are JSON objects (LEAF_SCHEMA), linked to its repeated ancestor."""
    return lines.select("line_id", "line").mapInPandas(_leaves, LEAF_SCHEMA)


def rejects(lines: DataFrame) -> DataFrame:
    """Lines (line_id, reason) that give no children: missing, broken, too deep for the JSON reader, or no object."""
    from lumenloom.operators.drift import _rejects

    found = lines.selectExpr("cast(line_id as long) as row_id", "line as text").mapInPandas(_rejects, "row_id long, reason string")
    return found.withColumnRenamed("row_id", "line_id")
