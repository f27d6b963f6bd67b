"""Streaming removal of repeated deliveries against a brute-force version."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lumenloom.session import new_folder
from lumenloom.streaming import dedup

T0 = dt.datetime(2026, 3, 1)


def brute(rows):
    best, out = {}, set()
    for key, at, row_id in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in best:
            out.add(row_id)
        best[key] = row_id
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, received_at timestamp, row_id long")


def some_rows(n, keys, days, seed):
    r = random.Random(seed)
    # one key has a third of all rows; some times are equal
    return [("hot" if r.random() < 0.33 else f"k{r.randrange(keys)}", T0 + dt.timedelta(minutes=r.randrange(days * 1440)), i) for i in range(n)]


def test_matches_brute_force_within_the_horizon(spark):
    rows = some_rows(1500, 700, 5, 1)
    got = {r["row_id"] for r in dedup.surplus(spark, table(spark, rows), horizon="7 days").collect()}
    assert got == brute(rows)


def test_copies_later_than_the_horizon_are_looked_up(spark):
    rows = some_rows(1200, 500, 60, 2)
    got = {r["row_id"] for r in dedup.surplus(spark, table(spark, rows), horizon="1 hour", batches=6).collect()}
    assert got == brute(rows)


def test_a_second_delivery_batch_goes_on_from_the_checkpoint(spark):
    rows = some_rows(600, 300, 4, 3)
    folder = new_folder(spark, "resume")
    for part in (rows[:350], rows[350:]):
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("key string, received_at timestamp, row_id long").parquet(f"{folder}/in")
        dedup.run_stream(source, f"{folder}/out", f"{folder}/state", "7 days", 32)
    got = [r["row_id"] for r in dedup.settle(spark.read.schema(dedup._LOG).parquet(f"{folder}/out")).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_empty_table(spark):
    assert dedup.surplus(spark, table(spark, [])).count() == 0


def test_identifiers_parts_nulls_and_clashing_columns(spark):
    rows = [
        (1, " Ab ", 0, T0, "x"), (2, "aB", 0, T0, "x"), (3, "ab ", 1, T0, "x"), (4, None, 0, T0, "x"), (5, " ​", 0, T0, "x"),
        (6, None, 0, T0, "x"), (7, "ab", None, T0, "x"), (8, "AB", None, None, "x"), (9, "ab", 0, T0 - dt.timedelta(1), "x"),
    ]
    df = spark.createDataFrame(rows, "event_id long, mid string, part int, received_at timestamp, key string")
    found = dedup.surplus(spark, dedup.deliveries(df, "t", "mid", "event_id", "part"))
    assert sorted(r["row_id"] for r in found.collect()) == [1, 2, 8]
    kept = dedup.keep_first(df, "mid", "event_id", "part")
    assert sorted(r["event_id"] for r in kept.collect()) == [3, 4, 5, 6, 7, 9]
    assert kept.columns == df.columns


def test_bloom_never_forgets():
    import numpy as np

    bloom = dedup.Bloom(first=100)
    seen = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    for part in np.array_split(seen, 7):
        bloom.add(part)
    assert bloom.has(seen).all() and len(bloom.layers) > 3
    assert bloom.has(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.1


def test_ident(spark):
    row = spark.createDataFrame([("\t X1　",)], "a string").select(dedup.ident(F.col("a")).alias("a")).first()
    assert row["a"] == "x1"



def test_the_store_holds_no_more_than_the_horizon(spark, tmp_path):
    schema = "key string, received_at timestamp, row_id long"
    day = dt.timedelta(days=1)
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for n in range(5):  # sixty new keys a day, and one of the first day again
        rows = [(f"k{n}-{k}", T0 + n * day, n * 100 + k) for k in range(60)] + [("k0-7", T0 + n * day + dt.timedelta(hours=1), n * 100 + 99)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        dedup.run_stream(source(), str(tmp_path / "out"), str(tmp_path / "check"), "1 day", 1)
    log = spark.read.parquet(str(tmp_path / "out"))
    assert {r["row_id"] for r in dedup.settle(log).collect()} == {99, 199, 299, 399, 499}
    gone = {r["key"] for r in log.filter("kind = 'evicted'").collect()}
    assert gone >= {f"k{n}-{k}" for n in range(3) for k in range(60)}
