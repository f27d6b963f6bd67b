"""Conversations from message rows.

Every message points at the one before it. Pointer jumping doubles the stride of all pointers at once: after
k joins a message knows its ancestor 2^k steps up and the distance to it, so the longest conversation takes
as many joins as its length has binary digits. A pointer that has reached a beginning is retired and only
answers from then on. A pointer that names no message is an orphan; pointers that never reach a beginning run
in a cycle. A session whose messages form one path is numbered along it; branches, several beginnings and
cycles are merged by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.session import stage
from lumenloom.streaming.dedup import ident, keep_first

#: Spellings of the speakers (fixed values of the data).
SPEAKERS = {
    "user": ["user", "human", "customer"],
    "assistant": ["assistant", "ai", "model", "bot"],
    "system": ["system", "developer"],
    "tool": ["tool", "function", "tool_result"],
}
_HOUR = 3_600_000_000
_UNSEEN = r"(?U)[^\s\x{0000}-\x{0020}\x{0085}\x{00a0}\x{00ad}\x{180e}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"


def speaker(role: Column) -> Column:
    """Name of the speaker in any letter case and padding; null for other roles."""
    name = ident(role)
    return F.coalesce(*[F.when(name.isin(spellings), F.lit(s)) for s, spellings in SPEAKERS.items()])


def visible(content: Column) -> Column:
    """Whether anything but white, no-break and zero-width space is there."""
    return F.coalesce(content.rlike(_UNSEEN), F.lit(False))


def micros(stamp: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 time with any offset (none is UTC) or of epoch seconds or milliseconds."""
    text = F.trim(stamp)
    number = F.try_to_number(F.when(text.rlike(r"^\d{9,14}$"), text), F.lit("99999999999999"))
    epoch = F.when(number >= 100_000_000_000, number.cast("long") * 1000).otherwise(number.cast("long") * 1_000_000)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?$"), F.upper(F.replace(text, F.lit(","), F.lit("."))))
    iso = F.regexp_replace(iso, r"\s+(?=[Z+-])", "")
    iso = F.regexp_replace(iso, r"(:\d{2}(?:\.\d+)?[+-]\d{2}):?(\d{2})$", "$1:$2")
    iso = F.regexp_replace(iso, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    iso = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.coalesce(epoch, F.unix_micros(iso.try_cast("timestamp")))


def messages(chat: DataFrame) -> DataFrame:
    """Messages without surplus copies, in terms of this module; rows without session belong to no conversation."""
    kept = keep_first(chat.filter("session_id is not null"), "id", "row_id")
    return kept.select(
        "session_id",
        F.col("row_id").cast("long").alias("row_id"),
        F.coalesce(ident(F.col("id")), F.concat(F.lit("\u0000"), F.col("row_id").cast("string"))).alias("mid"),
        ident(F.col("reply_to")).alias("up"),
        speaker(F.col("role")).alias("who"),
        visible(F.col("content")).alias("seen"),
        micros(F.col("timestamp")).alias("at"),
    )


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sid": F.xxhash64("session_id"), "node": F.xxhash64("mid")})


def jumps(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pointers (sid, node, ptr, dist, orphan, back, cyclic) of rows (session_id, mid, up, at), and the tables of ancestors.

    ptr is the beginning that a message leads to and dist the distance to it; an orphan counts as a beginning.
    back: the message is older than the one it answers. cyclic: its pointers never reach a beginning. The k-th
    table (sid, node, ptr) holds the ancestors 2^k steps up. Messages are named by 64 bits of their session
    and 64 of their id.
    """
    if "at" not in rows.columns:
        rows = rows.withColumn("at", F.lit(None).cast("long"))
    links = _named(rows).select("sid", "node", F.xxhash64("up").alias("_up"), F.col("up").isNotNull().alias("_points"), "at")
    there = links.select("sid", F.col("node").alias("_up"), F.col("at").alias("_before"), F.lit(True).alias("_there"))
    first = links.join(there, ["sid", "_up"], "left").withColumn("_there", F.coalesce(F.col("_points") & F.col("_there"), F.lit(False)))
    state = stage(
        first.select(
            "sid", "node",
            F.when(F.col("_there"), F.col("_up")).otherwise(F.col("node")).alias("ptr"),
            F.col("_there").cast("long").alias("dist"),
            (~F.col("_there")).alias("done"),
            (F.col("_points") & ~F.col("_there")).alias("orphan"),
            F.coalesce(F.col("_there") & (F.col("at") < F.col("_before")), F.lit(False)).alias("back"),
        ),
        "pointers",
    )
    longest = state.groupBy("sid").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    retired, moving = state.filter("done"), state.filter("not done")
    tables = [moving.select("sid", "node", "ptr")]
    stride = 1
    while stride <= longest and not moving.isEmpty():
        answers = retired.unionByName(moving).select("sid", F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        moved = stage(
            moving.join(answers, ["sid", "ptr"]).select(
                "sid", "node", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"), "orphan", "back"
            ),
            "pointers",
        )
        retired, moving, stride = retired.unionByName(moved.filter("done")), moved.filter("not done"), stride * 2
        tables.append(moved.filter(F.col("dist") == stride).select("sid", "node", "ptr"))
    return retired.withColumn("cyclic", F.lit(False)).unionByName(moving.withColumn("cyclic", F.lit(True))).drop("done"), tables


def resolve(rows: DataFrame) -> DataFrame:
    """rows (session_id, mid, up, at, ...) with root (its hash), depth, orphan, back and cyclic, by pointer jumping.

    The depth of a cyclic message has no meaning.
    """
    state, _ = jumps(rows)
    named = _named(rows).join(state, ["sid", "node"])
    return named.withColumnsRenamed({"ptr": "root", "dist": "depth"}).drop("sid", "node")


def paths(chat: DataFrame) -> DataFrame:
    """Root-to-leaf paths (session_id, leaf_row_id, step_no, row_id) of the messages without surplus copies.

    A leaf is a message that no other answers; every leaf that leads to a beginning gives one path, step_no
    from 1 at the beginning. Ancestors come from the tables of the jumps, highest stride first, so that each is
    met once. As many rows as the sum of the lengths of all paths; cycles have none.
    """
    rows = stage(messages(chat), "messages")
    state, tables = jumps(rows)
    ids = _named(rows).select("sid", "node", "session_id", "row_id")
    parents = tables[0].select("sid", F.col("ptr").alias("node")).distinct()
    met = state.filter("not cyclic").join(parents, ["sid", "node"], "left_anti").select("sid", F.col("node").alias("leaf"), "node", (F.col("dist") + 1).alias("step_no"))
    for k in reversed(range(len(tables))):
        above = met.join(tables[k], ["sid", "node"]).select("sid", "leaf", F.col("ptr").alias("node"), (F.col("step_no") - (1 << k)).alias("step_no"))
        met = stage(met.unionByName(above.filter("step_no > 0")), "paths")
    leaves = ids.select("sid", F.col("node").alias("leaf"), F.col("row_id").alias("leaf_row_id"))
    return met.join(ids, ["sid", "node"]).join(leaves, ["sid", "leaf"]).select("session_id", "leaf_row_id", F.col("step_no").cast("int").alias("step_no"), "row_id")


def shapes(chat: DataFrame) -> DataFrame:
    """For each session: messages, beginnings, orphans, cyclic messages, and answers older than what they answer."""
    rows = resolve(stage(messages(chat), "messages"))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.count_if(~F.col("cyclic") & (F.col("depth") == 0)).alias("beginnings"), F.count_if("orphan").alias("orphans"),
        F.count_if("cyclic").alias("cyclic"), F.count_if("back").alias("out_of_time"),
    )


def turns(chat: DataFrame) -> DataFrame:
    """Messages (session_id, turn_no, row_id, who) of every conversation that stays, turn_no from 1 by time.

    A conversation goes if a message has no known speaker, no visible content, no readable time or an orphan
    pointer; if it has no user message; if its first message other than system is not the user's; or if a
    user message has no assistant message before the next user message or the end. A session whose messages
    form one path, each not older than the one it answers, is numbered by its distance from the beginning.
    Others are merged by time, then depth, then row_id; a cycle does not exclude a conversation by itself.
    Those are numbered by hours, and hours by session, so that no task holds a long conversation.
    """
    rows = stage(resolve(stage(messages(chat), "messages")), "resolved")
    place = F.struct("at", "depth", "row_id")
    bad = F.col("who").isNull() | ~F.col("seen") | F.col("at").isNull() | F.col("orphan")
    sessions = rows.groupBy("session_id").agg(
        F.max(bad).alias("bad"),
        F.bool_or(F.coalesce(F.col("who") == "user", F.lit(False))).alias("asked"),
        F.min_by(F.when(F.col("who") != "system", F.col("who")), F.when(F.col("who") != "system", place)).alias("opener"),
        # one beginning, no two messages at one distance from it, none out of time
        ((F.count_if(F.col("depth") == 0) == 1) & (F.max("depth") == F.count("*") - 1) & ~F.bool_or(F.col("cyclic") | F.col("back"))).alias("path"),
    )
    fine = sessions.filter("not bad and asked and opener = 'user'").select("session_id", "path")
    left = rows.join(fine, "session_id").withColumn("hour", F.floor(F.col("at") / _HOUR))

    within = Window.partitionBy("session_id", "hour").orderBy("at", "depth", "row_id")
    across = Window.partitionBy("session_id").orderBy("hour")
    talk = left.filter("who in ('user', 'assistant')").withColumn("next", F.lead("who").over(within))
    hours = talk.groupBy("session_id", "hour").agg(F.min_by("who", place).alias("first"))
    hours = hours.withColumn("following", F.lead("first").over(across)).drop("first")
    unanswered = talk.join(hours, ["session_id", "hour"]).filter("who = 'user' and coalesce(next, following, '') != 'assistant'").select("session_id").distinct()

    stay = left.join(unanswered, "session_id", "left_anti")
    straight = stay.filter("path").select("session_id", (F.col("depth") + 1).cast("int").alias("turn_no"), "row_id", "who")
    mixed = stay.filter("not path")
    sizes = mixed.groupBy("session_id", "hour").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    merged = mixed.withColumn("k", F.row_number().over(within)).join(sizes, ["session_id", "hour"])
    return straight.unionByName(merged.select("session_id", (F.col("earlier") + F.col("k")).cast("int").alias("turn_no"), "row_id", "who"))
