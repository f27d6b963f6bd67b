"""Exactly one copy of every message that was delivered at least once.

A keyed state store remembers the best copy of every identifier seen within an event-time horizon. Each
arriving row either opens a key, or loses against the remembered copy, or replaces it; the loser leaves the
query at once as surplus. Keys older than the watermark leave the store and go to a history that is part of
the output. About ten bits of every key that left stay in a Bloom filter, so that is what grows with the
history; all else in the state is bounded by the horizon. A bucket lets go when it next receives rows: a timer
of the event time would drop late rows, one of the clock would keep a bounded run from ending. A key that opens while the filter knows it is logged, and the late-arrival lookup
settles it against the history. State, output and source offsets are committed together by the checkpoint,
so a restart neither loses nor repeats a row.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenloom.session import drop_folder, new_folder

#: Characters that count as surrounding white space of an identifier.
EDGE = r"^[\s\x{0000}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{0000}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$"
#: Rows without a time of receipt count as received last (microseconds since 1970).
LAST = 253_370_764_800_000_000
#: Event times that the watermark follows; others, and rows without one, do not move it.
_FROM, _TO = 0, 7_258_118_400_000_000

_LOG = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("row_id", T.LongType()),
    ]
)
_STATE = T.StructType([T.StructField("blob", T.BinaryType())])


def ident(column: Column) -> Column:
    """Identifier without letter case and surrounding white space; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(column.cast("string"), EDGE, "")), F.lit(""))


def deliveries(df: DataFrame, tag: str, id_col: str, row_col: str, part_col: str | None = None) -> DataFrame:
    """Rows (key, received_at, row_id) of a table; rows without an identifier are never copies and stay out.

    tag tells the tables of one stream apart. part_col, where given, belongs to the key, null as a value.
    """
    key = F.concat(F.lit(f"{tag}|"), ident(F.col(id_col)))
    if part_col:
        key = F.concat(key, F.lit("|"), F.coalesce(F.col(part_col).cast("string"), F.lit("")))
    return df.select(
        key.alias("key"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        F.col(row_col).cast("long").alias("row_id"),
    ).filter("key is not null")


def _timed(rows: DataFrame) -> DataFrame:
    """Deliveries with ts, the time that orders them, and an event time within the range of the watermark."""
    ts = F.coalesce(F.unix_micros("received_at"), F.lit(LAST))
    event = F.when(ts.between(_FROM, _TO), ts).otherwise(0)
    return rows.select("key", ts.alias("ts"), "row_id", F.timestamp_micros(event).alias("received_at"))


class Bloom:
    """A growing Bloom filter: when its newest layer is full, a layer of twice the size is added."""

    def __init__(self, first: int = 4096) -> None:
        self.layers: list[tuple[int, np.ndarray]] = []
        self.room, self.next = 0, first

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return (low[:, None] + np.arange(7, dtype=np.uint64) * high[:, None]) % np.uint64(size)

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if not self.room:
                self.layers.append((self.next * 10, np.zeros(self.next * 10 // 8 + 1, np.uint8)))
                self.room, self.next = self.next, self.next * 2
            now, hashes = hashes[: self.room], hashes[self.room :]
            size, bits = self.layers[-1]
            at = self._places(now, size).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
            self.room -= len(now)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for size, bits in self.layers:
            at = self._places(hashes, size)
            got = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            found |= got.all(axis=1)
        return found


def _hash(keys: pd.Series) -> np.ndarray:
    return pd.util.hash_array(keys.to_numpy(object), categorize=False)


def combine(buckets: int):
    """Map-side combine: per Arrow batch one row for each key goes to the state; its losers pass by, spread out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["ts", "row_id"], kind="stable")
            lost = rows["key"].duplicated().to_numpy()
            home = (_hash(rows["key"]) % np.uint64(buckets)).astype(np.int64)
            spread = rows["row_id"].to_numpy() % buckets
            yield rows.assign(bucket=np.where(lost, spread, home), lost=lost)

    return run


def _merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    hot, bloom = pickle.loads(state.get[0]) if state.exists else (None, Bloom())
    lost, fresh = [], []
    for part in parts:
        lost.append(part.loc[part["lost"], ["key", "ts", "row_id"]])
        fresh.append(part.loc[~part["lost"], ["key", "ts", "row_id"]])
    fresh = [f for f in fresh if len(f)] or [pd.DataFrame({"key": pd.Series([], dtype=object), "ts": pd.Series([], dtype="int64"), "row_id": pd.Series([], dtype="int64")})]
    lost = lost or [fresh[0].iloc[:0]]
    new = pd.concat(fresh).assign(old=False, suspect=False)
    rows = new if hot is None else pd.concat([hot.assign(old=True), new])
    rows = rows.sort_values(["ts", "row_id"], kind="stable", ignore_index=True)
    again = rows["key"].duplicated().to_numpy()
    kept, losers = rows[~again].copy(), rows[again]
    lost.append(losers[["key", "ts", "row_id"]])
    if hot is not None and len(losers):
        # a key keeps its suspicion whichever of its copies won
        kept["suspect"] |= kept["key"].isin(losers.loc[losers["suspect"], "key"])
    known = kept["key"].isin(hot["key"]) if hot is not None else pd.Series(False, kept.index)
    opened = ~kept["old"] & ~known
    if bloom.layers and opened.any():
        hit = bloom.has(_hash(kept.loc[opened, "key"]))
        kept.loc[opened[opened].index[hit], "suspect"] = True
    logged = kept[kept["suspect"] & ~kept["old"]]
    mark = state.getCurrentWatermarkMs() * 1000
    past = (kept["ts"].where(kept["ts"].between(_FROM, _TO), 0) < mark).to_numpy()
    gone = kept[past]
    if len(gone):
        bloom.add(_hash(gone["key"]))
    stay = kept.loc[~past, ["key", "ts", "row_id", "suspect"]]
    state.update((pickle.dumps((stay, bloom), 5),))
    yield pd.concat(
        [frame[["key", "ts", "row_id"]].assign(kind=kind) for kind, frame in (("surplus", pd.concat(lost)), ("opened", logged), ("evicted", gone))]
    )[["kind", "key", "ts", "row_id"]]


def run_stream(source: DataFrame, out: str, checkpoint: str, horizon: str, buckets: int) -> None:
    """Drain a stream of deliveries (see deliveries) into the log at out.

    Calling it again with the same folders goes on where the last call ended.
    """
    shaped = _timed(source).mapInPandas(
        combine(buckets), "key string, ts long, row_id long, received_at timestamp, bucket long, lost boolean"
    )
    query = (
        shaped.withWatermark("received_at", horizon)
        .groupBy("bucket")
        .applyInPandasWithState(_merge, _LOG, _STATE, "append", GroupStateTimeout.NoTimeout)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def settle(log: DataFrame) -> DataFrame:
    """Surplus rows (key, row_id) of a log: those the store named, and those the late-arrival lookup finds.

    Only keys that opened again after they left the store are looked up; the number of their entries is the
    number of times a key left the store, however many copies it has.
    """
    named = log.filter("kind = 'surplus'").select("key", "row_id")
    suspects = log.filter("kind = 'opened'").select("key").distinct()
    entries = log.filter("kind in ('opened', 'evicted')").join(suspects, "key", "left_semi").select("key", "ts", "row_id")
    best = entries.groupBy("key").agg(F.min(F.struct("ts", "row_id")).alias("best"))
    late = entries.join(best, "key").filter("row_id != best.row_id").select("key", "row_id")
    return named.union(late).distinct()


def surplus(
    spark: SparkSession, rows: DataFrame, horizon: str = "7 days", batches: int = 4, keys_per_bucket: int = 20_000, rows_per_batch: int = 50_000_000
) -> DataFrame:
    """Surplus rows (key, row_id) of a table of deliveries, replayed as a stream in order of receipt.

    horizon: how long a key stays in the store after its copy was received; it bounds what the store holds,
    not the result. batches: least number of micro-batches of the replay, more if one would hold more than
    rows_per_batch rows. keys_per_bucket: rows of the table for one store value; the number of buckets follows
    the number of rows. Ties in received_at go to the smallest row_id; rows of one time, or none, are spread
    over the slices by their number. An empty table gives an empty result.
    """
    log = new_folder(spark, "dedup")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(slices, "received_at", "row_id").write.option("compression", "zstd").parquet(f"{log}/slices")
    staged = spark.read.parquet(f"{log}/slices")
    count = staged.count()
    buckets = max(32, 1 << math.ceil(math.log2(max(1, count) / keys_per_bucket + 1)))
    batches = max(batches, math.ceil(count / rows_per_batch))
    if count:
        source = (
            spark.readStream.schema(staged.schema)
            .option("maxFilesPerTrigger", max(1, math.ceil(len(staged.inputFiles()) / batches)))
            .parquet(f"{log}/slices")
        )
        run_stream(source, f"{log}/log", f"{log}/checkpoint", horizon, buckets)
        drop_folder(spark, f"{log}/slices")
        drop_folder(spark, f"{log}/checkpoint")
        found = spark.read.schema(_LOG).parquet(f"{log}/log")
    else:
        found = spark.createDataFrame([], _LOG)
    return settle(found)


def keep_first(df: DataFrame, id_col: str, row_col: str, part_col: str | None = None) -> DataFrame:
    """Batch form for bounded tables: the rows of df without surplus copies; rows without identifier all stay.

    The copy to keep is found by a partial aggregate over the keys, so that a hot key shrinks before the
    shuffle; the rows themselves are joined by their number.
    """
    keyed = deliveries(df, "t", id_col, row_col, part_col)
    best = _timed(keyed).groupBy("key").agg(F.min(F.struct("ts", "row_id")).alias("b")).select(F.col("b.row_id").alias("_kept"))
    with_id = df.filter(ident(F.col(id_col)).isNotNull()).join(best, F.col(row_col).cast("long") == F.col("_kept"), "left_semi")
    return with_id.unionByName(df.filter(ident(F.col(id_col)).isNull()))
