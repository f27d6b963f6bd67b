"""Conversations follow their pointers: ties in time, branches, cycles, paths, and messages out of time."""

import datetime
import random

from lumenloom.llm import conversations

CHAT = "row_id long, session_id string, id string, reply_to string, role string, content string, timestamp string, received_at timestamp"
T0 = datetime.datetime(2026, 3, 1)


def _chat(spark, rows):
    return spark.createDataFrame([(k, s, i, p, role, "text", str(1772359200 + at), T0) for k, s, i, p, role, at in rows], CHAT)


def _order(df):
    return [r["row_id"] for r in sorted(df.collect(), key=lambda r: (r["session_id"], r["turn_no"]))]


def test_messages_of_one_time_stand_in_the_order_of_their_pointers(spark):
    n = 40
    number = list(range(n))
    random.Random(3).shuffle(number)
    rows = [(number[k], "s", f"m{k}", f"m{k - 1}" if k else None, "user" if k % 2 == 0 else "assistant", 0) for k in range(n)]
    assert _order(conversations.turns(_chat(spark, rows))) == number


def test_branches_and_cycles_are_merged_by_time(spark):
    tree = [(0, "s", "a", None, "user", 0), (1, "s", "b", "a", "assistant", 3), (2, "s", "c", "a", "assistant", 2), (3, "s", "d", None, "user", 4), (4, "s", "e", "d", "assistant", 5)]
    loop = [(10, "t", "x", "y", "user", 0), (11, "t", "y", "x", "assistant", 1)]
    back = [(20, "u", "p", None, "user", 1), (21, "u", "q", "p", "assistant", 2), (22, "u", "r", "q", "system", 0)]
    assert _order(conversations.turns(_chat(spark, tree + loop + back))) == [0, 2, 1, 3, 4, 10, 11, 22, 20, 21]
    shape = {r["session_id"]: (r["messages"], r["beginnings"], r["orphans"], r["cyclic"], r["out_of_time"]) for r in conversations.shapes(_chat(spark, tree + loop + back)).collect()}
    assert shape == {"s": (5, 2, 0, 0, 0), "t": (2, 0, 0, 2, 1), "u": (3, 1, 0, 0, 1)}


def test_paths_against_walking_up(spark):
    r = random.Random(7)
    up = {k: None if k == 0 else r.randrange(max(0, k - 3), k) for k in range(200)}
    up.update({300: 301, 301: 300, 302: 300, 400: 999})
    rows = [(k, "s", f"m{k}", None if p is None else f"m{p}", "user", k) for k, p in up.items()]
    want = set()
    for leaf in set(up) - set(up.values()):
        way, at = [], leaf
        while at in up and len(way) <= len(up):
            way.append(at)
            at = up[at]
        if len(way) <= len(up):
            want |= {(leaf, step + 1, node) for step, node in enumerate(reversed(way))}
    assert {(x["leaf_row_id"], x["step_no"], x["row_id"]) for x in conversations.paths(_chat(spark, rows)).collect()} == want
    assert conversations.paths(_chat(spark, [])).count() == 0
