"""Level-batch incremental clustering: batches of points update all levels, and clusters that drifted are anchored anew.

New points join the first leader within the radius of the highest zoom, or lead. Then level by level upwards the sums of
the children go to their parents, and what no longer fits is moved: a cluster whose centroid is more than miu radii (of the
level below) from its anchor is anchored at its centroid. If it is the lead child of its parent, the parent's anchor moves
with it, takes over clusters within the radius whose parents come later, and loses children that are farther; any other
child leaves if it is farther from its parent's anchor. Lead children never leave, so no cluster empties. Clusters without
a parent then join the first anchor within the radius, or lead a new one. All moves of a level are judged on the same
state, as joins, so the outcome does not depend on the order in which clusters are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mercator import MAX_ZOOM, MIN_ZOOM, distance, radius
from ..plans.shared import written
from .clustering import collapsed, leaders
from .radius_join import near

_NAMES = ("level", "key", "parent", "n", "sx", "sy", "lx", "ly")


def _entered(state: DataFrame | None, points: DataFrame, zoom: int) -> DataFrame:
    """(key, parent, n, sx, sy, lx, ly) of the highest level with the new points."""
    rows = written(collapsed(points), "points")
    fixed = None if state is None else state.filter(F.col("level") == zoom).select("key", F.col("lx").alias("mx"), F.col("ly").alias("my"))
    joined = rows.join(leaders(rows.select("key", "mx", "my"), radius(zoom), fixed), "key")
    its = lambda c: F.max(F.when(F.col("key") == F.col("leader"), F.col(c)))
    found = joined.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), its("mx").alias("lx"), its("my").alias("ly")).withColumnRenamed("leader", "key")
    found = found.withColumn("parent", F.lit(None).cast("long"))
    if state is not None:
        found = found.unionByName(state.filter(F.col("level") == zoom).drop("level"))
    its = lambda c: F.max(c).alias(c)
    return found.groupBy("key").agg(its("parent"), *(F.sum(c).alias(c) for c in ("n", "sx", "sy")), its("lx"), its("ly"))


def level_batch(state: DataFrame | None, points: DataFrame, max_zoom: int = MAX_ZOOM, min_zoom: int = MIN_ZOOM, miu: float = 0.5) -> DataFrame:
    """State (level, key, parent, n, sx, sy, lx, ly) after a batch of points (seq, mx, my), all later than earlier ones.

    state: None starts anew. lx, ly: a cluster's anchor. An empty batch changes nothing but what had drifted before.
    """
    nodes, out = _entered(state, points, max_zoom), []
    for zoom in range(max_zoom, min_zoom, -1):
        r = radius(zoom - 1)
        drifted = F.col("parent").isNotNull() & (distance(F.col("mx"), F.col("my"), F.col("lx"), F.col("ly")) > miu * r)
        nodes = nodes.withColumns({"mx": F.col("sx") / F.col("n"), "my": F.col("sy") / F.col("n")}).withColumn("drifted", drifted)
        nodes = written(nodes.withColumns({"lx": F.when(F.col("drifted"), F.col("mx")).otherwise(F.col("lx")), "ly": F.when(F.col("drifted"), F.col("my")).otherwise(F.col("ly"))}), "nodes")
        anchors = None
        if state is not None:
            moves = nodes.filter("drifted and key = parent").select("key", F.col("mx").alias("tx"), F.col("my").alias("ty"))
            anchors = state.filter(F.col("level") == zoom - 1).withColumnRenamed("parent", "above").select("key", "above", "lx", "ly").join(moves, "key", "left")
            anchors = written(anchors.select("key", "above", F.coalesce("tx", "lx").alias("mx"), F.coalesce("ty", "ly").alias("my"), F.col("tx").isNotNull().alias("moved")), "anchors")
            taken = near(nodes.filter("parent is not null and key <> parent"), anchors.filter("moved"), r).groupBy(F.col("a").alias("key")).agg(F.min("b").alias("taker"))
            own = anchors.select(F.col("key").alias("parent"), F.col("mx").alias("px"), F.col("my").alias("py"), "moved")
            held = nodes.join(taken, "key", "left").join(own, "parent", "left")
            far = (F.col("key") != F.col("parent")) & (F.col("moved") | F.col("drifted")) & (distance(F.col("mx"), F.col("my"), F.col("px"), F.col("py")) > r)
            parent = F.when(F.col("taker") < F.col("parent"), F.col("taker")).when(far, F.lit(None)).otherwise(F.col("parent"))
            nodes = written(held.withColumn("parent", parent).select(nodes.columns), "nodes")
        orphans = nodes.filter("parent is null").select("key", "mx", "my")
        found = leaders(orphans, r, None if anchors is None else anchors.select("key", "mx", "my"))
        nodes = nodes.join(found, "key", "left").withColumn("parent", F.coalesce("parent", "leader")).withColumn("level", F.lit(zoom))
        nodes = written(nodes.select(*_NAMES, "mx", "my"), "nodes")
        out.append(nodes.select(*_NAMES))
        its = lambda c: F.max(F.when(F.col("key") == F.col("parent"), F.col(c)))
        up = nodes.groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy")), its("mx").alias("lx"), its("my").alias("ly")).withColumnRenamed("parent", "key")
        if anchors is None:
            nodes = up.withColumn("parent", F.lit(None).cast("long"))
        else:
            up = up.join(anchors.select("key", "above", "mx", "my"), "key", "left")
            nodes = up.select("key", F.col("above").alias("parent"), "n", "sx", "sy", F.coalesce("mx", "lx").alias("lx"), F.coalesce("my", "ly").alias("ly"))
    out.append(written(nodes.withColumn("level", F.lit(min_zoom)).select(*_NAMES), "nodes"))
    return reduce(DataFrame.unionByName, out)
