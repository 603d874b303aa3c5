"""Radius join: pairs within a distance, as an equi-join of grid cells.

Several sets of points can be joined, and clustered, at once: keys of one set share what stands above their first SET bits,
and the cells of each set are moved by it, so that points of different sets never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mercator import distance

#: Bits of a key that number the points of one set.
SET = 40


def of_set(number: Column, seq: Column) -> Column:
    """The key of point seq in a set."""
    return F.shiftleft(number.cast("long"), SET) + seq


def set_of(key: Column) -> Column:
    """The set of a key, as its bits above SET."""
    return key.bitwiseAND(F.lit(-1 << SET))


def _cell(v: Column, r: float) -> Column:
    return F.floor(v / F.lit(r)).cast("long")


def _around(right: DataFrame, r: float) -> DataFrame:
    """(b, bx, by, ci, cj): right (key, mx, my) in the nine cells around its own."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = right.select(F.col("key").alias("b"), F.col("mx").alias("bx"), F.col("my").alias("by"), F.explode(steps).alias("d"))
    return b.select("b", "bx", "by", (set_of(F.col("b")) + _cell(F.col("bx"), r) + F.col("d.i")).alias("ci"), (_cell(F.col("by"), r) + F.col("d.j")).alias("cj"))


def _within(d: Column, r: float, strict: bool) -> Column:
    return d < F.lit(r) if strict else d <= F.lit(r)


def near(left: DataFrame, right: DataFrame, r: float, strict: bool = False) -> DataFrame:
    """(a, b, d) keys and distance of rows of left and right (key, mx, my) within r (strict: nearer than r), each pair once.

    The right side is sent to the nine cells around its own, the left side stays in its cell; no theta join is planned.
    """
    a = left.select(F.col("key").alias("a"), F.col("mx").alias("ax"), F.col("my").alias("ay"), (set_of(F.col("key")) + _cell(F.col("mx"), r)).alias("ci"), _cell(F.col("my"), r).alias("cj"))
    pairs = a.join(_around(right, r), ["ci", "cj"]).withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return pairs.filter(_within(F.col("d"), r, strict)).select("a", "b", "d")


def apart(left: DataFrame, right: DataFrame, r: float, strict: bool = False) -> DataFrame:
    """The rows of left (key, mx, my, ...) with no row of right (key, mx, my) within r; an anti-join of cells."""
    b = _around(right, r)
    d = distance(F.col("mx"), F.col("my"), F.col("bx"), F.col("by"))
    return left.join(b, (set_of(F.col("key")) + _cell(F.col("mx"), r) == b.ci) & (_cell(F.col("my"), r) == b.cj) & _within(d, r, strict), "left_anti")
