"""The driver contract."""

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["cond", "mean", "std", "cost", "n", "on_frontier"] and df.count() > 0
