"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "mx", "my", "n"]
