"""Points from a database: the scans against the same rows in memory, with predicates that reach it."""

import contextlib
import io
from datetime import datetime

import pytest

from cartograin.sources import points as sources

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, datetime(2024, 1, 1 + k % 20, k % 24), ["click", "view", "a click here", None][k % 4], None if k == 7 else float(k % 90), float(-k % 80)) for k in range(200)]
    return spark.createDataFrame(rows, "id long, create_at timestamp, text string, x double, y double")


@pytest.fixture(scope="module")
def database(spark, table, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/points;create=true"
    table.write.format("jdbc").options(url=url, dbtable="tweets", driver=DERBY).save()
    return sources.from_jdbc(spark, url, "tweets", 0, 200, 3, driver=DERBY)


def test_columns_and_ranges(database, table):
    assert database.columns == ["tid", "create_at", "text", "x", "y"]
    assert database.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, database.collect())) == sorted(map(tuple, table.collect())) or {tuple(map(str, r)) for r in database.collect()} == {tuple(map(str, r)) for r in table.collect()}


@pytest.mark.parametrize("ask", [{}, {"keyword": "click"}, {"start": "2024-01-05 00:00:00", "end": "2024-01-09 04:00:00"}, {"keyword": "click", "start": "2024-01-05 00:00:00"}, {"limit": 11}])
def test_scans(database, table, ask):
    plain = table.withColumnRenamed("id", "tid")
    assert sorted(map(tuple, sources.scan(database, **ask).collect())) == sorted(map(tuple, sources.scan(plain, **ask).collect()))


def test_times_and_columns_reach_the_database(database):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        sources.scan(database, None, "2024-01-05 00:00:00", "2024-01-09 00:00:00").explain("formatted")
    plan = shown.getvalue()
    assert "GreaterThanOrEqual(create_at" in plan and "LessThanOrEqual(create_at" in plan and "ReadSchema: struct<create_at:timestamp,text" not in plan
