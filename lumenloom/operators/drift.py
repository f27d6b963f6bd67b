"""Schemas that drift between files: one table for all of them, and a report of every change.

Tagged-union inference: every record gives the set of its paths with the type tag that each carries. Fusing
the sets of a file keeps all alternatives of a path side by side instead of forcing one type, and fusing is
associative, so it runs as a partial aggregate. Comparing the fused schema of a file with that of the file
before shows the alternatives that came and went; values of records found in both files tell a renamed
field from one that was removed beside one that was added.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.session import stage

#: Members whose name is the name of a model: lower case, in parts joined by hyphens. Field names have none.
MODEL_NAME = re.compile(r"[a-z0-9.]+(?:-[a-z0-9.]+)+")
_FILE = ["producer", "kind", "file_id"]
#: A file's records meet what is asked of it in as many places.
_SLICES = 16


def tag(value: object) -> str:
    """Type tag of a non-null JSON value."""
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(value)]


def _member(name: str) -> str:
    return "*" if MODEL_NAME.fullmatch(name) else name


def alternatives(body: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, tag) of every non-null member of an object, at any depth; elements of arrays fuse into one path."""
    if isinstance(body, dict):
        for name, value in body.items():
            at = f"{path}.{_member(name)}" if path else _member(name)
            if value is not None:
                yield at, tag(value)
                yield from alternatives(value, at)
    elif isinstance(body, list):
        for value in body:
            yield from alternatives(value, path + "[]")


def _bare(value: object) -> object:
    """Without null members, so that a missing and a null optional field are equal."""
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if v is not None}
    return [_bare(v) for v in value] if isinstance(value, list) else value


def value_at(body: object, path: str) -> object:
    """Value of a path in one record: below models a map by model, below arrays a list; None if nothing is there."""

    def take(value: object, parts: list[str]) -> object:
        if not parts:
            return value
        if isinstance(value, list):
            got = [take(v, parts) for v in value]
            return got if any(v is not None for v in got) else None
        if not isinstance(value, dict):
            return None
        if parts[0] == "*":
            many = {k: take(v, parts[1:]) for k, v in value.items() if MODEL_NAME.fullmatch(k)}
            many = {k: v for k, v in many.items() if v is not None}
            return many or None
        return take(value.get(parts[0]), parts[1:])

    return take(body, path.replace("[]", "").split("."))


def parse(text: object) -> dict:
    """A JSON object; {} for anything else."""
    try:
        body = json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return {}
    return body if isinstance(body, dict) else {}


def _schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fused within each batch before anything is shuffled."""
    for batch in batches:
        fused: dict[tuple, None] = {}
        for producer, kind, file_id, written_at, body in batch.itertuples(index=False):
            file = (producer, kind, file_id, written_at)
            fused[(*file, None, None)] = None
            for path, t in alternatives(parse(body)):
                fused[(*file, path, t)] = None
        yield pd.DataFrame(list(fused), columns=["producer", "kind", "file_id", "written_at", "path", "tag"])


def file_schemas(records: DataFrame) -> DataFrame:
    """One row for each file: (producer, kind, file_id, written_at, paths map<path, sorted tags>)."""
    seen = records.select(*_FILE, "written_at", "body").mapInPandas(
        _schemas, "producer string, kind string, file_id long, written_at timestamp, path string, tag string"
    )
    fused = seen.groupBy(*_FILE).agg(F.min("written_at").alias("written_at"), F.collect_set(F.struct("path", "tag")).alias("s"))
    return fused.withColumn("s", F.filter("s", lambda x: x["path"].isNotNull()))


def previous_file(files: DataFrame) -> DataFrame:
    """files with before, the file of the same producer and kind written just before.

    Files are ordered within days and days within a producer and kind, so a producer with very many files is
    not sorted in one task. Files of one time are ordered by file_id, files without a time come first.
    """
    slim = files.select(*_FILE, F.coalesce("written_at", F.lit("1970-01-01").cast("timestamp")).alias("at")).withColumn("day", F.to_date("at"))
    place = F.struct("at", "file_id")
    days = slim.groupBy("producer", "kind", "day").agg(F.max(place)["file_id"].alias("last"))
    earlier = days.withColumn("carried", F.lag("last").over(Window.partitionBy("producer", "kind").orderBy("day"))).drop("last")
    inside = F.lag("file_id").over(Window.partitionBy("producer", "kind", "day").orderBy("at", "file_id"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("producer", "kind", "day")]
    return (
        slim.withColumn("inside", inside).alias("a").join(earlier.alias("b"), same, "left")
        .select(*[F.col(f"a.{c}").alias(c) for c in _FILE], F.coalesce("a.inside", "b.carried").alias("before"))
    )


def _up(path: str) -> str:
    """The path around a member, '' at the top."""
    return path.rpartition(".")[0]


def _below(path: str, tops: set[str]) -> bool:
    parts, so_far = path.split("."), ""
    for part in parts[:-1]:
        so_far = f"{so_far}.{part}" if so_far else part
        if so_far in tops or so_far.removesuffix("[]") in tops:
            return True
    return False


def compare(old: dict[str, tuple], new: dict[str, tuple]) -> tuple[list[str], list[str], list[str]]:
    """Topmost paths (removed, added, retyped); paths below a reported one are left out."""
    retyped = {p for p in old.keys() & new.keys() if old[p] != new[p]}
    removed = {p for p in old.keys() - new.keys() if not _below(p, retyped)}
    added = {p for p in new.keys() - old.keys() if not _below(p, retyped)}
    retyped = {p for p in retyped if not _below(p, retyped)}
    return (
        sorted(p for p in removed if not _below(p, removed)),
        sorted(p for p in added if not _below(p, added)),
        sorted(retyped),
    )


def _tags(pairs: object) -> dict[str, tuple]:
    out: dict[str, set] = {}
    for p in pairs:
        out.setdefault(p["path"], set()).add(p["tag"])
    return {p: tuple(sorted(t)) for p, t in out.items()}


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for producer, kind, file_id, before, s, t in batch.itertuples(index=False):
            new, old = _tags(s), _tags(t)
            removed, added, retyped = compare(old, new)
            pairs = [{"old": r, "new": a} for r in removed for a in added if _up(r) == _up(a) and old[r] == new[a]]
            out.append((producer, kind, file_id, before, removed, added, retyped, pairs))
        yield pd.DataFrame(out, columns=["producer", "kind", "file_id", "before", "removed", "added", "retyped", "pairs"])


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of the candidate paths of a record, on the old or the new side of a comparison."""
    for batch in batches:
        out = []
        for change, key, record_id, side, paths, body in batch.itertuples(index=False):
            parsed = parse(body)
            values = [value_at(parsed, p) for p in paths]
            texts = [None if v is None else json.dumps(_bare(v), sort_keys=True) for v in values]
            out.append((change, key, record_id, side, [{"path": p, "value": v} for p, v in zip(paths, texts)]))
        yield pd.DataFrame(out, columns=["change", "record_key", "record_id", "side", "fields"])


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for producer, kind, file_id, removed, added, retyped, proven in batch.itertuples(index=False):
            gone, come = list(removed), list(added)
            for old, new in sorted((p["old"], p["new"]) for p in (proven if proven is not None else [])):
                if old in gone and new in come:
                    gone.remove(old)
                    come.remove(new)
                    out.append((producer, kind, file_id, "renamed", old, new))
            out += [(producer, kind, file_id, "removed", p, "") for p in gone]
            out += [(producer, kind, file_id, "added", "", p) for p in come]
            out += [(producer, kind, file_id, "retyped", p, p) for p in retyped]
        yield pd.DataFrame(out, columns=["producer", "kind", "file_id", "change_kind", "old_field", "new_field"])


def changes(records: DataFrame) -> DataFrame:
    """Rows (producer, kind, file_id, change_kind, old_field, new_field), file_id being the later file.

    A pair of paths is renamed if the values agree in every record_key of both files and one of them is not
    null; the check joins records by file and a slice of the key, so it spreads however many records a file has. Where
    several pairs agree, the alphabetically first are taken. Of rows of one key in one file the one with the
    smallest record_id counts. Bodies that are no JSON objects have no fields; files without fields count.
    """
    files = stage(file_schemas(records), "schemas")
    order = previous_file(files).filter("before is not null")
    after = order.join(files.select("file_id", "s"), "file_id")
    both = after.join(files.select(F.col("file_id").alias("before"), F.col("s").alias("t")), "before")
    seen = both.select(*_FILE, "before", "s", "t").mapInPandas(
        _compared,
        "producer string, kind string, file_id long, before long, removed array<string>, added array<string>,"
        " retyped array<string>, pairs array<struct<old:string,new:string>>",
    )
    seen = stage(seen.filter("size(removed) + size(added) + size(retyped) > 0"), "compared")
    asked = seen.filter("size(pairs) > 0").select(F.col("file_id").alias("change"), "before", "pairs")
    sides = asked.select(
        "change",
        F.explode(
            F.array(
                F.struct(F.col("before").alias("file_id"), F.lit("old").alias("side"), F.array_distinct("pairs.old").alias("paths")),
                F.struct(F.col("change").alias("file_id"), F.lit("new").alias("side"), F.array_distinct("pairs.new").alias("paths")),
            )
        ).alias("x"),
    ).select("change", "x.*", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("slice"))
    values = (
        records.select(F.col("file_id").cast("long"), "record_key", F.col("record_id").cast("long"), "body").filter("record_key is not null")
        .withColumn("slice", F.pmod(F.xxhash64("record_key"), F.lit(_SLICES)).cast("int"))
        .join(sides, ["file_id", "slice"]).select("change", "record_key", "record_id", "side", "paths", "body")
        .mapInPandas(_sides, "change long, record_key string, record_id long, side string, fields array<struct<path:string,value:string>>")
    )
    met = values.groupBy("change", "record_key").agg(
        *[F.min_by(F.when(F.col("side") == s, F.col("fields")), F.when(F.col("side") == s, F.col("record_id"))).alias(s) for s in ("old", "new")]
    ).filter("old is not null and new is not null")
    met = met.withColumn("slice", F.pmod(F.xxhash64("record_key"), F.lit(_SLICES)).cast("int"))
    wanted = asked.select("change", "pairs", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("slice")).select("change", "slice", F.explode("pairs").alias("pair"))
    judged = (
        met.join(wanted, ["change", "slice"])
        .select(
            "change",
            "pair",
            F.filter("old", lambda x: x["path"] == F.col("pair.old"))[0]["value"].alias("a"),
            F.filter("new", lambda x: x["path"] == F.col("pair.new"))[0]["value"].alias("b"),
        )
        .groupBy("change", "pair")
        .agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("equal"), F.bool_or(F.col("a").isNotNull()).alias("some"))
        .filter("equal and some")
        .groupBy(F.col("change").alias("file_id"))
        .agg(F.collect_list("pair").alias("proven"))
    )
    return (
        seen.join(judged, "file_id", "left")
        .select(*_FILE, "removed", "added", "retyped", "proven")
        .mapInPandas(_report, "producer string, kind string, file_id long, change_kind string, old_field string, new_field string")
    )


def _canonical(value: object) -> tuple:
    """(string, number, boolean, json, canonical) branches of a value; the canonical form is its text."""
    kind = tag(value)
    if kind == "string":
        return value, None, None, None, value
    if kind == "number":
        number = float(value)
        return None, number, None, None, str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    if kind == "boolean":
        return None, None, value, None, "true" if value else "false"
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return None, None, None, text, text


def members(body: object) -> Iterator[tuple[str, str, object]]:
    """(path, place, value) of every non-null member at any depth: paths as in alternatives, the place has the
    position in an array and the name of a model instead. Without recursion, as deep as the JSON reader goes."""
    todo: list[tuple[object, str, str]] = [(body, "", "")]
    while todo:
        value, path, place = todo.pop()
        if isinstance(value, dict):
            for name, below in value.items():
                if below is not None:
                    at, here = (f"{path}.{_member(name)}", f"{place}.{name}") if path else (_member(name), name)
                    yield at, here, below
                    todo.append((below, at, here))
        elif isinstance(value, list):
            todo += [(below, path + "[]", f"{place}[{k}]") for k, below in enumerate(value)]


def final_names(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, names map<path, path>): what the fields of a file are called in the last file of its producer and kind.

    changed: the rows of changes(). A rename counts for the files before it; chains of renames are followed, one
    join for each link. Only files with a field that was renamed later have a row.
    """
    place = F.struct(F.coalesce("written_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "file_id")
    order = files.select(*_FILE, place.alias("place"))
    renames = changed.filter("change_kind = 'renamed'").select("producer", "kind", "file_id", F.col("old_field").alias("old"), F.col("new_field").alias("new"))
    events = stage(renames.join(order.select("file_id", "place"), "file_id").drop("file_id"), "renames")
    following = events.select("producer", "kind", F.col("old").alias("last"), F.col("new").alias("_new"), F.col("place").alias("_place"))
    state = events.select("producer", "kind", "old", "place", F.col("new").alias("last"), F.col("place").alias("since"))
    keys = ["producer", "kind", "old", "place"]
    while not events.isEmpty():
        later = state.join(following, ["producer", "kind", "last"]).filter("_place > since").groupBy(*keys).agg(F.min_by(F.struct("_new", "_place"), F.col("_place")).alias("_n"))
        state = stage(state.join(later, keys, "left").select(*keys, F.coalesce("_n._new", "last").alias("last"), F.coalesce("_n._place", "since").alias("since"), F.col("_n").isNotNull().alias("moved")), "renames")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    named = files.select("file_id", *["producer", "kind"], place.alias("_at"), F.explode("s.path").alias("old")).distinct()
    met = named.join(state.select(*keys, "last"), ["producer", "kind", "old"]).filter("place > _at")
    first = met.groupBy("file_id", "old").agg(F.min_by("last", "place").alias("last")).filter("old != last")
    return first.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "last"))).alias("names"))


def renamed(path: str, names: dict[str, str]) -> str:
    """A path under the last name of itself or of the nearest path around it that was renamed."""
    at = path
    while at:
        if at in names:
            return names[at] + path[len(at) :]
        at = at[:-2] if at.endswith("[]") else at.rpartition(".")[0]
    return path


def _typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["record_id", "field", "place", "final_field", "tag", "as_string", "as_number", "as_boolean", "as_json", "canonical"]
    for batch in batches:
        out = []
        for record_id, body, names in batch.itertuples(index=False):
            known = dict(names) if names is not None else {}
            for field, place, value in members(parse(body)):
                out.append((record_id, field, place, renamed(field, known) if known else field, tag(value), *_canonical(value)))
        yield pd.DataFrame(out, columns=columns).astype({"as_number": "float64"})


def unified(records: DataFrame) -> DataFrame:
    """One row for each non-null field of a record at any depth: its tag, a branch for each type, and one text form.

    A field is a path as in changes; place tells its occurrences in a record apart by array position and model
    name, final_field is its name in the last file of the producer and kind. A field of conflicting types keeps
    every value: the branch of its own type is set, the others are null. Objects and arrays have their own row
    beside those of their members; array elements that are neither have none.
    """
    files = stage(file_schemas(records), "schemas")
    names = final_names(changes(records), files)
    rows = records.select(F.col("record_id").cast("long"), F.col("file_id").cast("long").alias("file_id"), "body").join(names, "file_id", "left")
    return rows.select("record_id", "body", "names").mapInPandas(
        _typed,
        "record_id long, field string, place string, final_field string, tag string, as_string string, as_number double, as_boolean boolean, as_json string, canonical string",
    )


def rejects(records: DataFrame) -> DataFrame:
    """Records (record_id, reason) that give no fields: missing, broken, too deep for the JSON reader, or no object."""
    return records.select(F.col("record_id").cast("long").alias("row_id"), F.col("body").alias("text")).mapInPandas(_rejects, "row_id long, reason string").withColumnRenamed("row_id", "record_id")


def reason_of(text: object) -> str | None:
    """Why a text is no JSON object; None if it is one."""
    if not isinstance(text, str):
        return "missing"
    try:
        body = json.loads(text)
    except RecursionError:
        return "too deep"
    except ValueError:
        return "broken"
    return None if isinstance(body, dict) else "no object"


def _rejects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(row_id, why) for row_id, text in batch.itertuples(index=False) if (why := reason_of(text))]
        yield pd.DataFrame(out, columns=["row_id", "reason"])
