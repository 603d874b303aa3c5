"""Frames as a data source: written and read back, added and replaced, and what a failed write leaves."""

import os

import pytest
from pyspark.sql import functions as F

from cartograin.sources import frames, sinks


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(frames.Frames)


def rows_of(df):
    return sorted(map(tuple, df.select("lat", "lng", "n").collect()))


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.range(1000).select((F.col("id") / 7 - 60).alias("lat"), (F.col("id") / 3 - 150).alias("lng"), (F.col("id") % 40).cast("int").alias("n")).repartition(3)


def test_round_trip(spark, clusters, tmp_path):
    path = f"file://{tmp_path}/out"
    clusters.write.format("frames").option("progress", 40).mode("append").save(path)
    assert rows_of(spark.read.format("frames").load(path)) == rows_of(clusters)
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".frame")]
    assert len(files) == 3
    parts = [sinks.unframe((tmp_path / "out" / f).read_bytes()) for f in files]
    assert {head for head, _ in parts} == {(40, 0.0, 0.0, 0.0)} and sum(len(body) for _, body in parts) == 1000


def test_small_splits_cover_all_records(spark, clusters, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    clusters.coalesce(1).write.format("frames").mode("append").save(path)
    monkeypatch.setattr(frames, "SPLIT", 700)
    parts = frames.FrameReader(path).partitions()
    assert len(parts) == 29 and sum(p.last - p.first for p in parts) == 1000
    read = [tuple(r.values()) for p in parts for b in frames.FrameReader(path).read(p) for r in b.to_pylist()]
    assert sorted(read) == rows_of(clusters)


def test_append_and_overwrite(spark, clusters, tmp_path):
    path, few = f"file://{tmp_path}/out", clusters.filter("n < 3")
    clusters.write.format("frames").mode("append").save(path)
    few.write.format("frames").mode("append").save(path)
    assert rows_of(spark.read.format("frames").load(path)) == sorted(rows_of(clusters) + rows_of(few))
    few.write.format("frames").mode("overwrite").save(path)
    assert rows_of(spark.read.format("frames").load(path)) == rows_of(few)
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".frame")]) == few.rdd.getNumPartitions()
    clusters.limit(0).write.format("frames").mode("overwrite").save(path)
    assert rows_of(spark.read.format("frames").load(path)) == []


def test_a_failed_write_leaves_nothing(spark, clusters, tmp_path):
    path = f"file://{tmp_path}/out"
    clusters.write.format("frames").mode("append").save(path)
    before = sorted(os.listdir(tmp_path / "out"))
    bad = clusters.withColumn("n", F.when(F.col("lat") > 80, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception):
        bad.write.format("frames").mode("append").save(path)
    assert rows_of(spark.read.format("frames").load(path)) == rows_of(clusters)
    assert sorted(os.listdir(tmp_path / "out")) == before


def test_a_frame_without_a_commit_is_not_read(spark, clusters, tmp_path):
    path = f"file://{tmp_path}/out"
    clusters.write.format("frames").mode("append").save(path)
    (tmp_path / "out" / "lost.frame").write_bytes(b"\0" * 100)
    assert rows_of(spark.read.format("frames").load(path)) == rows_of(clusters)
