"""Columnar shredding: exact reconstruction and defined results for broken input."""

import json
import random

from lumenloom.operators import shred


def test_levels_rebuild_every_list():
    r = random.Random(3)

    def block(depth):
        out = {"type": r.choice(["text", "image", None])}
        if depth < 4 and r.random() < 0.6:
            out["content"] = r.choice([None, [], [r.choice([None, block(depth + 1)]) for _ in range(r.randrange(4))]])
        return {k: v for k, v in out.items() if r.random() < 0.9}

    records = [r.choice([None, {"content": [block(0) for _ in range(r.randrange(3))]}, {}]) for _ in range(200)]
    root = shred.shred(records)
    got = {}
    for level in root.walk():
        for record, at, slot in level.rows():
            value = level.leaves[("type",)][1][slot] if ("type",) in level.leaves else None
            got[(record, at)] = value
    want = {}

    def note(record, items, at):
        for k, item in enumerate(items or []):
            if item is not None:
                want[(record, (*at, k))] = item.get("type")
                note(record, item.get("content"), (*at, k))

    for k, record in enumerate(records):
        if record is not None:
            want[(k, ())] = None
            note(k, record.get("content"), ())
    assert got == want


def children(spark, lines):
    df = spark.createDataFrame([(k, line, 9) for k, line in enumerate(lines)], "line_id long, line string, child int")
    return sorted(tuple(r) for r in shred.transcript_children(df).collect())


def test_children(spark):
    lines = [
        json.dumps({"message": {"content": "", "usage": {"a": 1, "b": {"c": 2, "d": None}, "e": {}}}, "usage": {"a": 3}}),
        json.dumps({"message": json.dumps({"content": {"type": "x", "content": [None, "s", {"content": "t"}]}})}),
        " \t" + json.dumps({"message": {"content": [None, {"type": None}, {"type": "y", "content": []}]}}) + "\n",
        "[1]", "{broken", None, "", "null", json.dumps({"message": "no json", "usage": [1]}),
    ]
    assert children(spark, lines) == sorted(
        [
            (0, "block", "0", "", "text"), (0, "usage", "a", "", ""), (0, "usage", "b.c", "b", ""), (0, "usage", "a", "", ""),
            (1, "block", "0", "", "x"), (1, "block", "0.1", "0", "text"), (1, "block", "0.2", "0", ""), (1, "block", "0.2.0", "0.2", "text"),
            (2, "block", "1", "", ""), (2, "block", "2", "", "y"),
        ]
    )


def test_very_deep_long_and_empty(spark):
    deep = {"type": "z"}
    for _ in range(400):
        deep = {"type": "z", "content": [deep]}
    got = children(spark, [json.dumps({"message": {"content": [deep]}}), json.dumps({"message": {"content": "x" * 300_000}}), "[" * 100_000])
    assert len([r for r in got if r[0] == 0]) == 401 and [r for r in got if r[0] == 1] == [(1, "block", "0", "", "text")]
    assert children(spark, []) == []


def test_leaves_keep_values(spark):
    df = spark.createDataFrame([(1, json.dumps({"message": {"content": [{"type": "text", "text": "hi"}, {"type": "n", "n": 2}]}}))], "line_id long, line string")
    got = {(r["node_path"], r["leaf"]): r["value"] for r in shred.transcript_leaves(df).collect()}
    assert got[("0", "text")] == "hi" and got[("1", "n")] == "2"


def test_leaves_are_those_of_the_whole_line(spark):
    lines = [
        json.dumps({"type": "a", "cost": 0.5, "modelUsage": {"m-1": {"n": 3}}, "item": {"parts": [{"k": True}, [7]]}, "message": json.dumps({"role": "user", "id": "i", "content": 5})}),
        json.dumps({"message": {"content": [{"type": "x", "content": False}, [[1], {"y": 2}], 4]}, "usage": [8]}), json.dumps({"message": "no json"}), "{broken", None,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {(r["line_id"], r["ancestor"], r["node_path"], r["leaf"], r["value"]) for r in shred.transcript_leaves(df).collect()}
    assert got == {
        (0, "", "", "type", "a"), (0, "", "", "cost", "0.5"), (0, "", "", "modelUsage.m-1.n", "3"), (0, "item.parts.[]", "0", "k", "true"), (0, "item.parts.[].[]", "1.0", "", "7"),
        (0, "", "", "message.role", "user"), (0, "", "", "message.id", "i"), (0, "", "", "message.content", "5"),
        (1, "message.content.[]", "0", "type", "x"), (1, "message.content.[]", "0", "content", "false"), (1, "message.content.[].[].[]", "1.0.0", "", "1"),
        (1, "message.content.[].[]", "1.1", "y", "2"), (1, "message.content.[]", "2", "_value", "4"), (1, "usage.[]", "0", "", "8"), (2, "", "", "message", "no json"),
    }
