"""Schema drift: each kind of change, and the unified table."""

import datetime as dt
import json

from lumenloom.operators import drift

SCHEMA = "record_id long, file_id long, producer string, kind string, written_at timestamp, record_key string, body string, path string"
T0 = dt.datetime(2026, 1, 1)


def records(spark, files):
    rows, n = [], 0
    for file_id, (day, bodies) in files.items():
        for key, body in bodies:
            n += 1
            rows.append((n, file_id, "p", "k", None if day is None else T0 + dt.timedelta(days=day), key, body if body is None or isinstance(body, str) else json.dumps(body), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r)[2:] for r in drift.changes(records(spark, files)).collect())


def test_kinds_of_change(spark):
    one = [("a", {"name": "x", "score": 1, "old": 5, "m": {"big-one": {"cost": 1}}, "list": [{"q": 1}]}), ("b", {"name": "y", "gone": True})]
    two = [("a", {"judge": "x", "score": "1", "new": 6, "m": {"tiny-2": {"cost": 1, "extra": 2}}, "list": [{"q": 1, "r": None}]}), ("b", {"judge": "y"}), ("c", {"deep": {"er": 1}})]
    assert changes(spark, {1: (0, one), 2: (1, two)}) == [
        (2, "added", "", "deep"), (2, "added", "", "m.*.extra"), (2, "added", "", "new"), (2, "removed", "gone", ""), (2, "removed", "old", ""),
        (2, "renamed", "name", "judge"), (2, "retyped", "score", "score"),
    ]


def test_no_shared_record_is_no_rename_and_null_is_no_proof(spark):
    assert changes(spark, {1: (0, [("a", {"u": 1})]), 2: (1, [("b", {"v": 1})])}) == [(2, "added", "", "v"), (2, "removed", "u", "")]
    files = {1: (0, [("a", {"u": None}), ("z", {"u": 1})]), 2: (1, [("a", {"v": None}), ("y", {"v": 1})])}
    assert changes(spark, files) == [(2, "added", "", "v"), (2, "removed", "u", "")]


def test_order_is_by_time_and_below_a_change_nothing_is_reported(spark):
    files = {9: (0, [("a", {"o": {"x": 1, "y": {"z": 1}}})]), 3: (2, [("a", {})]), 5: (1, [("a", {"o": "text"})])}
    assert changes(spark, files) == [(3, "removed", "o", ""), (5, "retyped", "o", "o")]


def test_broken_bodies_repeated_rows_and_empty_table(spark):
    files = {1: (None, [("a", "{broken"), ("a", None), (None, {"x": 1}), ("a", {"x": 1}), ("a", {"x": 1})]), 2: (1, [("a", "[1]")])}
    assert changes(spark, files) == [(2, "removed", "x", "")]
    assert changes(spark, {}) == []


def test_unified(spark):
    rows = drift.unified(records(spark, {1: (0, [("a", {"v": 1.5, "w": True, "x": "s", "y": [1], "z": None})]), 2: (1, [("a", {"v": "1.5"})])})).collect()
    got = {(r["record_id"], r["field"]): (r["tag"], r["as_string"], r["as_number"], r["as_boolean"], r["canonical"]) for r in rows}
    assert got[(1, "v")] == ("number", None, 1.5, None, "1.5") and got[(2, "v")] == ("string", "1.5", None, None, "1.5")
    assert got[(1, "w")][3] is True and (1, "z") not in got


def test_unified_splits_nested_conflicts(spark):
    one = {"m": {"big-one": {"cost": 1}, "tiny-2": {"cost": {"id": "a", "rev": 2}}}, "list": [{"q": 1}, None, {"q": "x"}]}
    rows = drift.unified(records(spark, {1: (0, [("a", one)])})).collect()
    got = {(r["field"], r["place"]): (r["tag"], r["as_string"], r["as_number"], r["canonical"]) for r in rows}
    assert got[("m.*.cost", "m.big-one.cost")] == ("number", None, 1.0, "1")
    assert got[("m.*.cost", "m.tiny-2.cost")] == ("object", None, None, '{"id": "a", "rev": 2}')
    assert got[("m.*.cost.rev", "m.tiny-2.cost.rev")][2] == 2.0
    assert got[("list[].q", "list[0].q")][2] == 1.0 and got[("list[].q", "list[2].q")][1] == "x"
    assert {f for f, _ in got} == {p for p, _ in drift.alternatives(one)} and len(rows) == len(got)


def test_renamed_fields_come_out_under_their_last_name(spark):
    files = {
        1: (0, [("a", {"x": 1, "o": {"p": "u"}}), ("b", {"x": 2, "o": {"p": "v"}})]), 2: (1, [("a", {"y": 1, "q": {"p": "u"}}), ("b", {"y": 2, "q": {"p": "v"}})]),
        3: (2, [("a", {"z": 1, "q": {"p": "u"}}), ("b", {"z": 2, "q": {"p": "v"}})]), 4: (3, [("a", {"z": 1, "x": 9, "q": {"p": "u"}})]),
    }
    rows = drift.unified(records(spark, files)).collect()
    assert {(r["field"], r["final_field"]) for r in rows} == {("x", "z"), ("y", "z"), ("z", "z"), ("x", "x"), ("o", "q"), ("o.p", "q.p"), ("q", "q"), ("q.p", "q.p")}
    assert drift.renamed("a[].b.c", {"a[].b": "a[].d"}) == "a[].d.c" and drift.renamed("ab.c", {"a": "z"}) == "ab.c"


def test_rejects_name_their_reason(spark):
    deep = '{"a":' * 200_000 + "1" + "}" * 200_000
    rows = [(1, None), (2, "{"), (3, "[1]"), (4, deep), (5, "{}")]
    got = {r["record_id"]: r["reason"] for r in drift.rejects(spark.createDataFrame(rows, "record_id long, body string")).collect()}
    assert got == {1: "missing", 2: "broken", 3: "no object", 4: "too deep"}
