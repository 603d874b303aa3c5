"""Points: scans by keyword, time and limit, time slices, and the order in which points are taken."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import lat_y, lng_x
from ..functions.text_match import match
from ..plans.shared import numbered


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, create_at, text, x, y) with coordinates that integer arithmetic derives from the table of events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS tid",
        "ts AS create_at",
        "event_type AS text",
        "-125.0D + 55.0D*((user_id*7919)%1000)/1000.0D + 1.5D*(((event_id*104729)%2001)-1000)/1000.0D AS x",
        "26.0D + 22.0D*((user_id*6007)%1000)/1000.0D + (((event_id*15485863)%2001)-1000)/1000.0D AS y",
    )


def from_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """The same columns from a database table (id, create_at, text, x, y), read in ranges of id."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=lower, upperBound=upper, numPartitions=partitions, **options)
    return reader.load().select(F.col("id").alias("tid"), "create_at", "text", "x", "y")


def scan(points: DataFrame, keyword: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """(tid, x, y) of points whose text matches and whose time is from start to end, both included; limit takes the first by tid."""
    found = points
    if start is not None:
        found = found.filter(F.col("create_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("create_at") <= F.lit(end).cast("timestamp"))
    found = found.filter(match(F.col("text"), keyword)).filter("x is not null and y is not null").select("tid", "x", "y")
    return found.orderBy("tid").limit(limit) if limit is not None else found


def projected(points: DataFrame) -> DataFrame:
    """points with mx, my in the unit square."""
    return points.withColumns({"mx": lng_x(F.col("x")), "my": lat_y(F.col("y"))})


def ordered(points: DataFrame, order: str = "original") -> DataFrame:
    """points with seq, dense from 0: original (by tid), reverse, spatial (by x, y) or reverse-spatial."""
    keys = {
        "original": [F.asc("tid")],
        "reverse": [F.desc("tid")],
        "spatial": [F.asc("x"), F.asc("y"), F.asc("tid")],
        "reverse-spatial": [F.desc("x"), F.desc("y"), F.asc("tid")],
    }
    keys["spatial-reverse"] = keys["reverse-spatial"]
    if order not in keys:
        raise ValueError(f"unknown order {order!r}")
    return numbered(points, *keys[order])


def slices(start: datetime, end: datetime, days: int):
    """(number, from, to, progress in per cent) of the time slices; the last ends at end."""
    at, k = start, 0
    while at < end:
        to = min(at + timedelta(days=days), end)
        yield k, at, to, min(100, 100 * (to - start).days // max((end - start).days, 1))
        at, k = to, k + 1


def transferred(points: DataFrame, start: datetime, end: datetime, days: int, keyword: str | None = None) -> DataFrame:
    """(slice, progress, tid, row) of points from start to before end whose text matches; row is [lat, lng, tid].

    One scan for all slices: write it by slice, or filter a slice, to send them one after another. progress is per cent of
    the whole span after the slice. Points without a time or a place are left out.
    """
    span = [(k, progress) for k, _, _, progress in slices(start, end, days)]
    at = slice_number(F.col("create_at"), start, days)
    progress = F.element_at(F.create_map(*[F.lit(int(v)) for pair in span for v in pair]), F.col("slice").cast("int")) if span else F.lit(100)
    found = points.filter((F.col("create_at") >= F.lit(start)) & (F.col("create_at") < F.lit(end)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    found = found.filter(match(F.col("text"), keyword)).withColumn("slice", at)
    return found.select("slice", progress.alias("progress"), "tid", F.array(F.col("y"), F.col("x"), F.col("tid").cast("double")).alias("row"))


def slice_number(create_at, start: datetime, days: int):
    """The slice of a time as a column; slices are half open."""
    return F.floor(F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), create_at.cast("timestamp_ntz")) / (86400 * days)).cast("long")
