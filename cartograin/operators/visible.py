"""What a viewport shows of a hierarchy: clusters in a box, and the tree-cut that expands distinguishable ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mercator import boxes, distance, limit_zoom, pixel_distance, radius, within_any, x_lng, y_lat
from ..plans.shared import removed, written

MEASURES = ("min", "max", "avg")


def shown(clusters: DataFrame) -> DataFrame:
    """clusters with lng and lat of their centroids."""
    return clusters.withColumns({"lng": x_lng(F.col("mx")), "lat": y_lat(F.col("my"))})


def visible(tree: DataFrame, bbox, zoom: int, by_leader: bool = False, low: int = 0, high: int = 17) -> DataFrame:
    """Clusters of a level whose centroid (or leader's place, as incremental hierarchies ask) is strictly inside a box in degrees."""
    x, y = (F.col("lx"), F.col("ly")) if by_leader else (F.col("mx"), F.col("my"))
    return shown(tree.filter((F.col("level") == limit_zoom(zoom, low, high)) & within_any(x, y, bbox)))


def cluster_distance(tree: DataFrame, zoom: int, a: int, b: int) -> DataFrame:
    """(distance, radius) of two clusters' centroids at a level, and of the level's clusters; distance -1 if one is missing."""
    level = tree.filter((F.col("level") == zoom) & F.col("key").isin(a, b))
    of = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    found = level.agg(of(a, "mx").alias("ax"), of(a, "my").alias("ay"), of(b, "mx").alias("bx"), of(b, "my").alias("by"))
    return found.select(F.coalesce(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), F.lit(-1.0)).alias("distance"), F.lit(radius(zoom)).alias("radius"))


def spread(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(level, key, kids, low, high, mean) of the distances between each two children of a cluster; of (level, key): of these only."""
    kids = tree.filter("parent is not null").select((F.col("level") - 1).alias("level"), F.col("parent").alias("pkey"), F.col("key").alias("ckey"), "mx", "my")
    if of is not None:
        kids = kids.join(of.select("level", F.col("key").alias("pkey")), ["level", "pkey"], "left_semi")
    other = kids.select("level", "pkey", F.col("ckey").alias("dkey"), F.col("mx").alias("dx"), F.col("my").alias("dy"))
    d = kids.join(other, ["level", "pkey"]).filter("ckey < dkey").withColumn("d", distance(F.col("mx"), F.col("my"), F.col("dx"), F.col("dy")))
    pairs = d.groupBy("level", "pkey").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.avg("d").alias("mean"))
    counts = kids.groupBy("level", "pkey").agg(F.count("*").alias("kids"))
    return counts.join(pairs, ["level", "pkey"], "left").withColumnRenamed("pkey", "key")


def measured(tree: DataFrame) -> DataFrame:
    """tree with low, high and mean of the distances between children, and children; joined to it unless it holds them."""
    if {"low", "high", "mean", "children"} <= {*tree.columns}:
        return tree
    found = spread(tree).withColumnRenamed("kids", "children")
    return tree.drop("low", "high", "mean", "children").join(found, ["level", "key"], "left").na.fill(0, ["children"])


def _expands(d: float, measure: str, highest: int) -> Column:
    """Whether a cluster's children lie d apart by the measure (one child always does); those of the highest level have none."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    value = F.col({"min": "low", "max": "high", "avg": "mean"}[measure])
    return (F.col("level") < highest) & F.coalesce((F.col("children") == 1) | (value >= d), F.lit(False))


def _last(tree: DataFrame, highest: int | None) -> int:
    return highest if highest is not None else tree.agg(F.max("level")).first()[0] or 0


def tree_cut(tree: DataFrame, frontier: DataFrame, d: float, measure: str = "max", lowest: int = 0, highest: int | None = None) -> DataFrame:
    """The frontier (level, key) with each distinguishable cluster replaced by its children, level by level.

    lowest: the frontier's first level; highest: the tree's last one (asked of it if not given). Each level is one join
    with the clusters of the next; nothing is counted or written on the way. Rows that stay find no child: they are dealt by
    numbers that no cluster has.
    """
    names = ["level", "key", "n", "mx", "my", "diameter", "expands"]
    highest = _last(tree, highest)
    nodes = measured(tree).withColumns({"diameter": F.col("high") / 2, "expands": _expands(d, measure, highest)}).select("parent", *names)
    at = nodes.join(frontier.select("level", "key"), ["level", "key"], "left_semi").select(names)
    kids = nodes.toDF("parent_", *(f"{c}_" for c in names))
    for level in range(lowest, highest):
        joined = at.join(kids.filter(F.col("level_") == level + 1), F.expr(f"if(level = {level} and expands, key, -1 - key) = parent_"), "left")
        at = joined.selectExpr(*(f"if(key_ is null, {c}, {c}_) as {c}" for c in names))
    return shown(at.drop("expands"))


def bipartite_cut(tree: DataFrame, frontier: DataFrame, d: float, measure: str = "max", highest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept clusters of a frontier, and the open ones, which the tree-cut goes on with.

    Clusters are sorted by count; the head ends at the first whose running sum reaches what follows it. The head is kept,
    and so are tail clusters that do not expand; the others are replaced by their children, which are cut again, until
    three or fewer are left, nothing expands, or the largest of the head is a single point; what is left then is open.
    Running sums go over distinct counts, and over ties of the one count where the head ends.
    """
    names = ["level", "key", "n", "mx", "my"]
    nodes = measured(tree).withColumn("expands", _expands(d, measure, _last(tree, highest))).select("parent", *names, "expands")
    todo, kept = written(nodes.join(frontier.select("level", "key"), ["level", "key"], "left_semi").select(*names, "expands"), "frontier"), []
    while True:
        sums = [(r["n"], r["k"]) for r in todo.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()]
        whole, count = sum(n * k for n, k in sums), sum(k for _, k in sums)
        if count <= 3:
            break
        before = 0
        for edge, k in sums:
            need = next((x for x in range(1, k + 1) if 2 * (before + edge * x) >= whole), 0) if 2 * (before + edge * k) >= whole else 0
            if need:
                break
            before += edge * k
        ties = todo.filter(F.col("n") == edge).orderBy("level", "key").limit(need).select("level", "key", F.lit(True).alias("tie"))
        parted = todo.join(ties, ["level", "key"], "left").withColumn("head", (F.col("n") > edge) | F.coalesce("tie", F.lit(False)))
        parted = written(parted.select(*names, "expands", "head"), "parted")
        removed(todo)
        kept.append(parted.filter("head or not expands").select(names))
        grown = parted.filter("not head and expands").select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
        todo = written(nodes.join(grown, ["level", "parent"], "left_semi").select(*names, "expands"), "frontier")
        if sums[0][0] <= 1:
            break
    return reduce(DataFrame.unionByName, kept, frontier.select(names).limit(0)), todo.select(names)


def cut(tree: DataFrame, bbox, zoom: int, pixels: float = 1.0, measure: str = "max", bipartite: bool = False, high: int | None = None, exact: bool = True) -> DataFrame:
    """Visible clusters, cut: children at least so many pixels apart are shown instead of their cluster.

    high: the tree's last level (asked of it if not given). exact: the tree is hierarchy()'s or grown()'s, where a child is
    within two radii of its cluster, so that all below is within four radii of the zoom of what is visible: nothing else
    is looked at.
    """
    high = _last(tree, high)
    zoom = limit_zoom(zoom, 0, high)
    front, d = visible(tree, bbox, zoom, high=high), pixel_distance(zoom, pixels)
    around = tree.filter(F.col("level") >= zoom)
    if exact:
        around = around.filter(_about(bbox, 4.001 * radius(zoom)))
    if not bipartite:
        return tree_cut(around, front, d, measure, zoom, high)
    kept, open_ = bipartite_cut(around, front, d, measure, high)
    return shown(kept.withColumn("diameter", F.lit(None).cast("double"))).unionByName(tree_cut(around, open_, d, measure, zoom, high))


def _about(bbox, margin: float) -> Column:
    """Whether a place is within a margin of a box in degrees."""
    sides = [(F.col("mx") >= w - margin) & (F.col("mx") <= e + margin) & (F.col("my") >= n - margin) & (F.col("my") <= s + margin) for w, n, e, s in boxes(bbox)]
    return reduce(Column.__or__, sides)


def result_stats(clusters: DataFrame) -> DataFrame:
    """(results, points, most, mean) of a result's clusters."""
    return clusters.agg(F.count("*").alias("results"), F.sum("n").alias("points"), F.max("n").alias("most"), F.avg("n").alias("mean"))
