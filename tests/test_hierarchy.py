"""Tree contraction against a walk."""

import random

import pytest

from lumenloom.operators import hierarchy

SCHEMA = "tree_id string, node_id string, parent string, src_table int, lab string"


def walk(rows):
    parent = {}
    for t, n, p in rows:
        if t is None or n is None:
            continue
        if p is not None and not p.strip(" 0\t\n"):
            p = None
        old = parent.get((t, n))
        parent[(t, n)] = min(x for x in (old, p) if x is not None) if old is not None or p is not None else None
    parent = {k: (p if p is not None and (k[0], p) in parent else None) for k, p in parent.items()}
    out, below = {}, {k: 0 for k in parent}
    for t, n in parent:
        path, at = [n], n
        while parent[(t, at)] is not None and len(path) <= len(parent):
            at = parent[(t, at)]
            path.append(at)
        if parent[(t, at)] is not None:
            loop, at = False, parent[(t, n)]
            for _ in range(len(parent)):
                loop, at = loop or at == n, parent[(t, at)]
            out[(t, n)] = ("cycle" if loop else "under_cycle", "", -1, "", -1)
        else:
            out[(t, n)] = ("tree", path[-1], len(path) - 1, "/".join(reversed(path)))
            for a in path[1:]:
                below[(t, a)] += 1
    return {k: v if len(v) == 5 else (*v, below[k]) for k, v in out.items()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    links = hierarchy.edges(df, "t", "tree_id", "node_id", "parent")
    return {
        (r["tree_id"], r["node_id"]): (r["status"], r["root_id"], r["depth"], r["node_path"], r["n_below"]) for r in hierarchy.contract(links).collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    r = random.Random(seed)
    rows = []
    for t in range(6):
        n = r.randrange(1, 60)
        for k in range(n):
            rows.append((f"t{t}", f"n{k}", r.choice([None, "", " ", "0000", "gone", *[f"n{r.randrange(n)}"] * 12])))
    rows += r.sample(rows, 10)
    assert run(spark, rows) == walk(rows)


def test_deep_wide_and_self_loop(spark):
    rows = [("deep", f"d{k:03}", f"d{k - 1:03}" if k else None) for k in range(150)]
    rows += [("wide", "root", None), *[("wide", f"w{k}", "root") for k in range(300)]]
    rows += [("self", "a", "a"), ("self", "b", "a"), ("self", "c", "b")]
    rows += [("ring", "x", "y"), ("ring", "y", "z"), ("ring", "z", "x"), (None, "q", None), ("ring", None, "x"), ("deep", "w1", None)]
    assert run(spark, rows) == walk(rows)


def test_empty_and_descendants(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("t", "a", None, 1, ""), ("t", "b", "a", 1, ""), ("t", "c", "b", 1, "")], SCHEMA)
    found = hierarchy.descendants(hierarchy.contract(hierarchy.edges(df, "s", "tree_id", "node_id", "parent")))
    assert sorted((r["ancestor_id"], r["node_id"], r["distance"]) for r in found.collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_ids_may_hold_slashes_and_stars_are_wide(spark):
    rows = [("t", "a/b", None), ("t", "c", "a/b"), ("t", "d/e/f", "c")] + [("star", f"n{k}", None if k == 0 else "n0") for k in range(3000)]
    found = hierarchy.contract(hierarchy.edges(spark.createDataFrame(rows, "tree string, node string, up string"), "s", "tree", "node", "up"))
    got = {(r["ancestor_id"], r["node_id"], r["distance"]) for r in hierarchy.descendants(found).filter("tree_id = 't'").collect()}
    assert got == {("a/b", "c", 1), ("a/b", "d/e/f", 2), ("c", "d/e/f", 1)}
    assert {r["n_below"] for r in found.filter("tree_id = 'star' and depth = 0").collect()} == {2999}
    assert found.filter("depth = 2").first()["node_path"] == "a/b/c/d/e/f"
