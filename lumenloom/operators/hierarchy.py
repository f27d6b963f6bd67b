"""Full hierarchies from parent-child rows by tree contraction.

Forward, each round rakes every leaf into its parent and splices an independent set of unary chain nodes out
of their chains; what is removed is written down with the state it had. When no node can be removed, the
nodes left are roots and, for each loop, one node that is its own parent. Backward, the records are read in
reverse: a raked leaf hangs below its parent, a spliced node sits just above its child, so one join with the
nodes already known gives root, depth, path and number of descendants. A round is two exchanges, in which
nodes send to their parent or child and meet what they kept themselves; what children send is summed before
it is exchanged, so a parent of many costs no more than others. Rounds grow with the logarithm of the deepest
chain. Trees and nodes travel as hashes of 64 bits each; paths are arrays, so ids may hold any character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.session import drop_folder, new_folder, stage

RESULT = ["src_table", "tree_id", "node_id", "status", "root_id", "depth", "node_path", "n_below"]
_BLANK = r"(?U)^[\s\x{200b}\x{feff}0]*$"


def no_parent(parent: Column) -> Column:
    """Null, blank and all-zero notations of "no parent"."""
    return parent.isNull() | parent.rlike(_BLANK)


def edges(df: DataFrame, src_table: str, tree: str, node: str, parent: str) -> DataFrame:
    """Child-to-parent rows (src_table, tree_id, node_id, parent) of a table, parent null where there is none.

    Rows without tree or node name no node and are left out.
    """
    return df.select(
        F.lit(src_table).alias("src_table"),
        F.col(tree).cast("string").alias("tree_id"),
        F.col(node).cast("string").alias("node_id"),
        F.when(~no_parent(F.col(parent).cast("string")), F.col(parent).cast("string")).alias("parent"),
    ).filter("tree_id is not null and node_id is not null")


#: What is known of a node in the end: ring is null for trees, else whether it is on the loop.
_STATE = ["parent", "lab", "w", "ew"]
_ONLY = "struct<node:bigint,hops:int,ew:bigint>"
_OWN = "struct<parent:bigint,lab:array<string>,w:bigint,ew:bigint,leaf:boolean>"


def _start(links: DataFrame) -> DataFrame:
    """One row for each distinct node, with its hashes; a parent that is not in the tree is none.

    Of repeated rows with different parents the smallest parent counts.
    """
    nodes = links.groupBy("src_table", "tree_id", "node_id").agg(F.min("parent").alias("parent"))
    named = nodes.select(
        F.xxhash64("src_table", "tree_id").alias("tree"), F.xxhash64("node_id").alias("node"), "src_table", "tree_id", "node_id",
        F.when(F.col("parent").isNotNull(), F.xxhash64("parent")).alias("parent"),
    )
    there = named.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    return named.join(there, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")


def _first(start: DataFrame) -> DataFrame:
    """The state before the first round: which nodes have no children."""
    parents = start.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct().withColumn("above", F.lit(True))
    return start.join(parents, ["tree", "node"], "left").select(
        "tree", "node", "parent", F.array("node_id").alias("lab"), F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("ew"), F.col("above").isNull().alias("leaf")
    )


def _priority(name: Column, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), name)


def _round(alive: DataFrame, turn: int) -> DataFrame:
    """One rake and one compress step; column what tells alive, leaf and chain rows apart."""
    none = lambda kind: F.lit(None).cast(kind)
    inner = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))

    alive = alive.withColumn("leaf", F.col("leaf") & F.coalesce(inner, F.lit(False)))

    # leaves give their weight to the parent, other children their name and what a splice above them would change
    own = F.struct("parent", "lab", "w", "ew", "leaf")
    mine = F.struct(F.col("node").alias("to"), own.alias("own"), none("bigint").alias("gain"), none("bigint").alias("more"), none(_ONLY).alias("only"))
    up = F.struct(
        F.col("parent").alias("to"), none(_OWN).alias("own"), F.when(F.col("leaf"), F.col("w") + F.col("ew")).alias("gain"),
        (~F.col("leaf")).cast("bigint").alias("more"), F.when(~F.col("leaf"), F.struct("node", F.size("lab").alias("hops"), "ew")).alias("only"),
    )
    sent = alive.select("tree", F.explode(F.array_compact(F.array(mine, F.when(inner, up)))).alias("m"))
    met = sent.groupBy("tree", F.col("m.to").alias("node")).agg(
        F.first("m.own", ignorenulls=True).alias("own"), F.coalesce(F.sum("m.gain"), F.lit(0)).alias("gain"), F.coalesce(F.sum("m.more"), F.lit(0)).alias("more"), F.max("m.only").alias("only")
    )
    flat = met.select("tree", "node", "own.parent", "own.lab", (F.col("own.w") + F.col("gain")).alias("w"), "own.ew", "own.leaf", "more", "only")
    unary = ~F.col("leaf") & (F.col("more") == 1) & inner
    first = _priority(F.col("node"), turn)
    # of neighbours at most one is spliced: the one of highest priority
    splice = unary & (first > _priority(F.col("parent"), turn)) & (first > _priority(F.col("only.node"), turn))

    # a spliced node hands its parent, label and weight to its only child
    kept = F.struct("parent", "lab", "w", "ew", "leaf", "more", "only", "splice")
    gift = F.struct("parent", "lab", (F.col("w") + F.col("ew")).alias("add"))
    mine = F.struct(F.col("node").alias("to"), kept.alias("own"), none("struct<parent:bigint,lab:array<string>,add:bigint>").alias("gift"))
    down = F.struct(F.col("only.node").alias("to"), none(f"struct<parent:bigint,lab:array<string>,w:bigint,ew:bigint,leaf:boolean,more:bigint,only:{_ONLY},splice:boolean>").alias("own"), gift.alias("gift"))
    sent = flat.withColumn("splice", splice).select("tree", F.explode(F.array_compact(F.array(mine, F.when(F.col("splice"), down)))).alias("m"))
    met = sent.groupBy("tree", F.col("m.to").alias("node")).agg(F.first("m.own", ignorenulls=True).alias("own"), F.first("m.gift", ignorenulls=True).alias("gift"))
    taken, gift = F.col("gift").isNotNull(), F.col("gift")
    return met.select(
        "tree", "node",
        F.when(F.col("own.leaf"), "leaf").when(F.col("own.splice"), "chain").otherwise("alive").alias("what"),
        F.when(taken, gift["parent"]).otherwise(F.col("own.parent")).alias("parent"),
        F.when(taken, F.concat(gift["lab"], F.col("own.lab"))).otherwise(F.col("own.lab")).alias("lab"),
        "own.w",
        F.when(taken, gift["add"] + F.col("own.ew")).otherwise(F.col("own.ew")).alias("ew"),
        "own.only",
        # whether raking has left it without children
        (F.col("own.more") == 0).alias("leaf"),
    )


def contract(links: DataFrame) -> DataFrame:
    """Hierarchy of every distinct node of links (see edges), columns RESULT and path, the ids from root to node.

    status: tree; cycle for nodes on a loop (a node that names itself is one); under_cycle for nodes whose
    ancestors lead into a loop. For the latter two root_id and node_path are '', path is empty, and depth and
    n_below are -1. An empty table gives an empty result.
    """
    spark = links.sparkSession
    home = new_folder(spark, "hierarchy")
    start = stage(_start(links), "start", f"{home}/start")
    alive = _first(start)
    turns = 0
    while True:
        done = stage(_round(alive, turns), "round", f"{home}/round{turns}")
        counts = {r["what"]: r["n"] for r in done.groupBy("what").agg(F.count("*").alias("n")).collect()}
        turns += 1
        alive = done.filter("what = 'alive'").select("tree", "node", *_STATE, "leaf")
        if not counts.get("leaf") and not counts.get("chain"):
            break
    ring = F.col("parent").isNotNull()
    ends = alive.select(
        "tree", "node", F.when(ring, True).alias("ring"), F.when(ring, F.array().cast("array<string>")).otherwise(F.col("lab")).alias("path"), F.when(ring, -1).otherwise(F.col("w") - 1).alias("n_below")
    )
    stage(ends, "known", f"{home}/known/part=0")
    step = 0
    known = lambda: spark.read.schema(ends.schema).parquet(*[f"{home}/known/part={k}" for k in range(step + 1)])
    for turn in reversed(range(turns - 1)):
        done = spark.read.parquet(f"{home}/round{turn}")
        for undo in (_unsplice, _unrake):
            stage(undo(done, known()), "known", f"{home}/known/part={step + 1}")
            step += 1
    for turn in range(turns):
        drop_folder(spark, f"{home}/round{turn}")
    tree = F.col("ring").isNull()
    found = known().join(start.select("tree", "node", "src_table", "tree_id", "node_id"), ["tree", "node"])
    return found.select(
        "src_table", "tree_id", "node_id",
        F.when(tree, "tree").when(F.col("ring"), "cycle").otherwise("under_cycle").alias("status"),
        F.when(tree, F.get("path", F.lit(0))).otherwise("").alias("root_id"),
        F.when(tree, F.size("path") - 1).otherwise(-1).alias("depth"),
        F.array_join("path", "/").alias("node_path"),
        F.col("n_below").cast("int").alias("n_below"),
        "path",
    )


def _unsplice(done: DataFrame, known: DataFrame) -> DataFrame:
    """Spliced nodes sit just above their child: its path without its own labels."""
    chain = done.filter("what = 'chain'").select("tree", F.col("only.node").alias("only"), "node", "w", F.col("only.hops").alias("hops"), F.col("only.ew").alias("ew"))
    below = known.withColumnRenamed("node", "only")
    return chain.join(below, ["tree", "only"]).select(
        "tree", "node", "ring",
        F.when(F.col("ring").isNull(), F.slice("path", F.lit(1), F.size("path") - F.col("hops"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("ring").isNull(), F.col("w") + F.col("ew") + F.col("n_below")).otherwise(-1).alias("n_below"),
    )


def _unrake(done: DataFrame, known: DataFrame) -> DataFrame:
    """Raked leaves hang below their parent; below a loop they are not on it."""
    leaves = done.filter("what = 'leaf'").select("tree", "node", "parent", "lab", "w")
    above = known.select("tree", F.col("node").alias("parent"), "ring", "path")
    tree = F.col("ring").isNull()
    return leaves.join(above, ["tree", "parent"]).select(
        "tree", "node", F.when(~tree, False).alias("ring"), F.when(tree, F.concat("path", "lab")).otherwise(F.col("path")).alias("path"), F.when(tree, F.col("w") - 1).otherwise(-1).alias("n_below")
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """Pairs (src_table, tree_id, ancestor_id, node_id, distance) of tree nodes, from the paths of contract().

    As many rows as the sum of the depths; nodes of loops have no finite set of ancestors and are left out.
    """
    above = F.slice("path", 1, F.size("path") - 1)
    pairs = hierarchy.filter("status = 'tree' and depth > 0").select("src_table", "tree_id", "node_id", F.posexplode(above).alias("at", "ancestor_id"), "depth")
    return pairs.select("src_table", "tree_id", "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))
