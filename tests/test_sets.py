"""Several sets of points clustered at once, and the experiments that do so."""

import random
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograin.operators import agreement, clustering
from cartograin.operators.radius_join import SET, of_set
from cartograin.plans import queries

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = [(k, 1000 + k, START + timedelta(hours=k), rng.random() * 0.3, rng.random() * 0.3) for k in range(400)]
    rows += [(400 + k, 1400 + k, START + timedelta(hours=400 + k), *rows[7 * k][3:]) for k in range(20)]
    return spark.createDataFrame(rows, "seq long, tid long, create_at timestamp, mx double, my double").cache()


def test_scaling_takes_the_sizes_of_its_sql(spark, points, monkeypatch):
    monkeypatch.setattr(queries, "SIZES", [50, 100])
    monkeypatch.setattr(queries, "_points", lambda *_: points)
    got = {(r.level, r.n): r.clusters for r in queries._scaling(spark, "").collect()}
    want = {}
    for n in (50, 100):
        want |= {(r.level, n): r["count"] for r in clustering.hierarchy(points.filter(F.col("seq") < n)).groupBy("level").count().collect()}
    assert got == want


@pytest.mark.parametrize("broadcast", ["10m", "64k", "-1"])
def test_sets_together_are_each_alone(spark, points, broadcast, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        sets = [points, points.withColumn("seq", 419 - F.col("seq")), points.filter("seq < 150")]
        together = clustering.hierarchy(reduce(DataFrame.unionByName, [p.withColumn("seq", of_set(F.lit(k), F.col("seq"))) for k, p in enumerate(sets)]), 7, 2)
        bits = lambda c: F.col(c).bitwiseAND(F.lit((1 << SET) - 1)).alias(c)
        for k, p in enumerate(sets):
            got = together.filter(F.shiftright("key", SET) == k).select("level", bits("key"), bits("parent"), "n", F.round("mx", 12).alias("mx"))
            want = clustering.hierarchy(p, 7, 2).select("level", "key", "parent", "n", F.round("mx", 12).alias("mx"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_slices_are_those_of_an_engine_fed_slice_by_slice(spark, points):
    ends = [(START + timedelta(hours=h), p) for h, p in ((150, 30), (300, 70), (500, 100))]
    got = {r.progress: (r.rand, r.adjusted_rand) for r in queries._slices_rand(points, ends, 3, 2).collect()}
    want, state, low = {}, None, START
    for high, progress in ends:
        now, so_far = points.filter((F.col("create_at") >= F.lit(low)) & (F.col("create_at") < F.lit(high))), points.filter(F.col("create_at") < F.lit(high))
        state, low = clustering.approximate(state, now, 3, 2), high
        pair = agreement.aligned(clustering.labels(so_far, clustering.hierarchy(so_far, 3, 2), 2, 3), clustering.labels(so_far, state, 2, 3))
        want[progress] = tuple(agreement.rand_indexes(pair).first())
    assert got == want and len(got) == 3
