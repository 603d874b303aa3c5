"""Greedy radius clustering at every zoom, batch and incremental.

The greedy rule takes points in the order of seq: a point with no earlier leader within the radius becomes a leader, any
other joins the earliest such leader. Space is cut into tiles of TILE radii; a task follows the rule over the points of many
tiles at once, each with a margin of HALO radii around it (greedy.decided), and decides what it can be sure of: not points
near the margin's edge, nor what depends on them. What is left open goes into another round, together with the leaders around
it; the earliest open point is always decided, and seldom is there more than one round. Where raw points are so dense that a
tile has over HOT of them, its first HOT are taken first, and what their leaders cover is joined to them by a plain radius
join, so that no tile is large. Levels are clustered from the highest zoom down, each from the clusters above, so a level
sees few points in a radius. From one level to the next there is one shuffle: members are dealt by the place of their
leader, and the task that gets them merges them and goes on with the rule. Coinciding points are one point of the first's seq.
hierarchy() and labels_at() take several sets of points at once, whose keys radius_join.of_set() tells apart: each has tiles of
its own, and all go through the levels together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import MAX_ZOOM, MIN_ZOOM, node_id, radius
from ..plans.shared import numbered, place, removed, shuffle_parts, written
from .greedy import decided
from .radius_join import SET, apart, near, set_of

#: Side of a tile (over twice the margin) and width of its margin in radii, and raw points of a tile that are taken at a time.
TILE, HALO, HOT = 32, 4, 1 << 17
#: Points of whole tiles that a task takes at a time.
GATHER = 1 << 15
#: The bits of a key that name its set.
_SETS = -1 << SET


def _tile(v: Column, r: float, by: float = 0.0) -> Column:
    return F.floor((v + F.lit(by * r)) / F.lit(TILE * r)).cast("long")


def _dealt(points: DataFrame, r: float) -> DataFrame:
    """points (mx, my, ...) with ti (above the bits of the key's set) and tj, in each tile that sees them; own: in their own one."""
    x, y, base = F.col("mx"), F.col("my"), set_of(F.col("key")) if "key" in points.columns else F.lit(0)
    seen = F.array_distinct(F.array(*(F.struct((base + _tile(x, r, a)).alias("ti"), _tile(y, r, b).alias("tj")) for a in (-HALO, HALO) for b in (-HALO, HALO))))
    dealt = points.withColumn("_tile", F.explode(seen)).select(*points.columns, "_tile.*")
    return dealt.withColumn("own", (F.col("ti") == base + _tile(x, r)) & (F.col("tj") == _tile(y, r)))


def _whole(batches, columns: tuple[str, ...]):
    """Tables of about GATHER rows that hold all rows of each tile (ti, tj), by which rows are sorted."""
    held, count, wanted = [], 0, GATHER
    for b in chain(batches, (None,)):
        if b is not None:
            held.append(b)
            count += b.num_rows
            if count < wanted:
                continue
        if not count:
            continue
        rows = pa.Table.from_batches(held)
        ti, tj = rows.column("ti").to_numpy(), rows.column("tj").to_numpy()
        others = np.flatnonzero((ti != ti[-1]) | (tj != tj[-1]))
        cut = len(ti) if b is None else int(others[-1]) + 1 if len(others) else 0  # the last tile may go on
        if cut:
            tile = np.cumsum((np.diff(ti[:cut], prepend=ti[:1]) != 0) | (np.diff(tj[:cut], prepend=tj[:1]) != 0))
            yield rows.slice(0, cut), tile, *(rows.column(c).to_numpy()[:cut] for c in columns)
        held, count = rows.slice(cut).to_batches(), len(ti) - cut
        wanted = max(GATHER, 2 * count)


def _ruled(tile, ti, tj, key, x, y, lead, side: float, r: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """decided() for points in tiles (ti, tj) of a side, of which all within the margin are here."""
    edge = (HALO - 1.001) * r
    dx, dy = x - ti * side, y - tj * side
    i, j = (np.floor((v + HALO * r) * (2 / r)).astype(np.int64) + 4 for v in (dx, dy))
    sure = (dx > -edge) & (dx < side + edge) & (dy > -edge) & (dy < side + edge)
    return decided(tile, i, j, key, x, y, lead, sure, r, strict)


def _decided(dealt: DataFrame, r: float, strict: bool, left: Accumulator) -> DataFrame:
    """The rows of points in their own tiles with leader and its place (px, py), null where it is open, which left counts.

    dealt: _dealt() rows with key and lead (whether a known leader)."""
    names, side = [c for c in dealt.columns if c not in ("ti", "tj", "own", "lead")], TILE * r

    def follow(batches):
        for rows, tile, ti, tj, key, x, y, lead, mine in _whole(batches, ("ti", "tj", "key", "mx", "my", "lead", "own")):
            leader, known = _ruled(tile, ti - (key & _SETS), tj, key, x, y, lead, side, r, strict)
            kept = np.flatnonzero(mine & ~lead)
            taken = rows.select(names).take(pa.array(kept))
            to, open_ = leader[kept], ~known[kept]
            left.add(int(open_.sum()))
            for name, of in (("leader", key), ("px", x), ("py", y)):
                taken = taken.append_column(name, pa.array(of[to], mask=open_))
            yield from taken.combine_chunks().to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name in names)
    # By a hash of the tile: where dealt is a union of joins by tile, one of them by broadcast, Spark 4.1 takes it for dealt by
    # (ti, tj) already and leaves out a shuffle by these, so that a task would miss leaders.
    rows = dealt.repartition(shuffle_parts(dealt.sparkSession), F.xxhash64("ti", "tj")).sortWithinPartitions("ti", "tj")
    return rows.mapInArrow(follow, f"{kinds}, leader long, px double, py double")


def _settled(spark: SparkSession, first: Callable[[Accumulator], DataFrame], r: float, fixed: DataFrame | None = None, strict: bool = False, path: str | None = None) -> DataFrame:
    """Rows (key, mx, my, ..., leader, px, py) of first with what it left open decided in further rounds, as tables.

    With path, all of them are written there, with late, whether they took more than a round; rows without a leader, which
    were open for a while, count for nothing. Tasks count what they leave open with an accumulator; a task that ran twice may count twice, but never too little.
    """
    done, lead, ask = [], fixed, first
    while True:
        left = spark.sparkContext.accumulator(0)
        found = ask(left)
        found = written(found.withColumn("late", F.lit(False)) if path and not done else found, "followed", None if done else path)
        if not left.value:
            if path and done:
                late = reduce(DataFrame.unionByName, [*done[1:], found]).withColumn("late", F.lit(True))
                return written(late.select(done[0].columns), "followed", path, append=True).filter("leader is not null")
            return reduce(DataFrame.unionByName, [*done, found])
        done.append(found.filter("leader is not null"))
        open_ = found.filter("leader is null").drop("leader", "px", "py", "late")
        new = done[-1].filter("key = leader").select("key", "mx", "my")
        lead = new if lead is None else lead.select("key", "mx", "my").unionByName(new)
        ask = partial(_asked, open_, r, lead, strict, again=True)


def _asked(points: DataFrame, r: float, lead: DataFrame | None, strict: bool, left: Accumulator, again: bool = False) -> DataFrame:
    """One round: points (key, mx, my, ...) with leader where it can be told; lead (key, mx, my): leaders that come before."""
    dealt = _dealt(points, r).withColumn("lead", F.lit(False))
    if lead is not None:
        tiles = points.select((set_of(F.col("key")) + _tile(F.col("mx"), r)).alias("ti"), _tile(F.col("my"), r).alias("tj")).distinct()
        around = _dealt(lead.select("key", "mx", "my"), r).join(tiles, ["ti", "tj"], "left_semi").withColumn("lead", F.lit(True))
        if again:
            dealt = dealt.join(tiles, ["ti", "tj"], "left_semi")
        dealt = dealt.unionByName(around, allowMissingColumns=True)
    return _decided(dealt, r, strict, left)


def _followed(points: DataFrame, r: float, fixed: DataFrame | None = None, strict: bool = False, path: str | None = None) -> DataFrame:
    """points (key, mx, my, ...) with leader, px and py, in rounds; fixed (key, mx, my): leaders that come before all points."""
    return _settled(points.sparkSession, partial(_asked, points, r, fixed, strict), r, fixed, strict, path)


def _risen(rows: DataFrame, zoom: int, path: str) -> DataFrame:
    """The clusters of a level, with their leaders one level lower, from the rows of the level above with theirs; one shuffle.

    Members are dealt to tiles by the place of their leader, half a radius from which the centroid is at most, so a tile has
    all members of each cluster in its view: its task merges them, in the order of keys, and goes on with the rule.
    """
    r = radius(zoom - 1)
    reach, side = (HALO + 0.501) * r, TILE * r
    spots = ", ".join(f"struct((leader & {_SETS}L) + cast(floor((px + {a!r}D) / {side!r}D) as long) as ti, cast(floor((py + {b!r}D) / {side!r}D) as long) as tj)" for a in (-reach, reach) for b in (-reach, reach))
    dealt = rows.select("leader", "key", "px", "py", "mx", "my", "n", "sx", "sy", "expansion_zoom", F.expr(f"explode(array_distinct(array({spots})))").alias("at"))
    dealt = dealt.select("leader", "key", "px", "py", "mx", "my", "n", "sx", "sy", "expansion_zoom", "at.*")
    dealt = dealt.repartition(shuffle_parts(rows.sparkSession), "ti", "tj").sortWithinPartitions("ti", "tj")

    def rise(left: Accumulator, batches):
        for _, tile, *columns in _whole(batches, ("ti", "tj", "leader", "key", "px", "py", "mx", "my", "n", "sx", "sy", "expansion_zoom")):
            order = np.lexsort((columns[3], columns[2], tile))
            tile, (ti, tj, leader, key, px, py, mx, my, n, sx, sy, expansion) = tile[order], (c[order] for c in columns)
            ti = ti - (leader & _SETS)
            new = np.ones(len(tile), bool)
            new[1:] = (tile[1:] != tile[:-1]) | (leader[1:] != leader[:-1])
            at = np.flatnonzero(new)
            children = np.diff(np.append(at, len(tile)))
            n, sx, sy = (np.add.reduceat(v, at) for v in (n, sx, sy))
            expansion = np.where(children == 1, expansion[at], zoom + 1).astype(np.int32)
            low, high, mean = _spread(np.cumsum(new) - 1, mx, my, len(at))
            mx, my = sx / n, sy / n
            tile, ti, tj = tile[at], ti[at], tj[at]
            dx, dy = mx - ti * side, my - tj * side
            view = (dx >= -HALO * r) & (dx <= side + HALO * r) & (dy >= -HALO * r) & (dy <= side + HALO * r)
            own = (np.floor(mx / side) == ti) & (np.floor(my / side) == tj)
            seen = np.flatnonzero(view | own)
            key, x, y = leader[at][seen], mx[seen], my[seen]
            to, known = _ruled(tile[seen], ti[seen], tj[seen], key, x, y, np.zeros(len(seen), bool), side, r, False)
            kept = np.flatnonzero(own[seen])
            taken, to, open_ = seen[kept], to[kept], ~known[kept]
            left.add(int(open_.sum()))
            plain = (leader[at], mx, my, n, sx, sy, px[at], py[at], children.astype(np.int64), expansion)
            arrays = [pa.array(v[taken]) for v in plain] + [pa.array(v[taken], mask=np.isnan(v[taken])) for v in (low, high, mean)]
            arrays += [pa.array(v[to], mask=open_) for v in (key, x, y)]
            yield pa.RecordBatch.from_arrays(arrays, [*_CLUSTER, "leader", "px", "py"])

    kinds = "key long, mx double, my double, n long, sx double, sy double, lx double, ly double, children long, expansion_zoom int, low double, high double, mean double, leader long, px double, py double"
    return _settled(rows.sparkSession, lambda left: dealt.mapInArrow(partial(rise, left), kinds), r, path=path)


def _spread(owner: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest and mean distance of each two members of n clusters, of which each one's stand together; nan for one member."""
    low, high, total, pairs = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n), np.zeros(n)
    step, at = 1, np.arange(len(owner))
    while len(at := at[at + step < len(owner)]) and len(at := at[owner[at] == owner[at + step]]):
        d = ((x[at] - x[at + step]) ** 2 + (y[at] - y[at + step]) ** 2) ** 0.5
        np.minimum.at(low, owner[at], d)
        np.maximum.at(high, owner[at], d)
        np.add.at(total, owner[at], d)
        np.add.at(pairs, owner[at], 1)
        step += 1
    none = pairs == 0
    low[none], high[none] = np.nan, np.nan
    return low, high, np.divide(total, pairs, out=np.full(n, np.nan), where=~none)


def _most(points: DataFrame, r: float) -> int:
    """How many points the fullest tile has."""
    tiles = points.groupBy(set_of(F.col("key")) + _tile(F.col("mx"), r), _tile(F.col("my"), r)).agg(F.count("*").alias("n"))
    return tiles.agg(F.max("n")).first()[0] or 0


def leaders(points: DataFrame, r: float, fixed: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(key, leader) for points (key, mx, my): key of the leader of each; fixed (key, mx, my): earlier leaders that stay.

    strict: only what is nearer than r is within the radius. Keys are distinct; an empty table gives an empty table.
    """
    most = _most(points, r)
    if most <= HOT:
        return _followed(points.select("key", "mx", "my"), r, fixed, strict).select("key", "leader")
    lead, rest, seq = fixed, points.select("key", "mx", "my"), F.col("key").bitwiseAND(F.lit((1 << SET) - 1))
    if fixed is not None:
        rest = written(apart(rest, fixed, r, strict), "uncovered")
        most = _most(rest, r)
    while True:
        cut = rest.agg(F.percentile_approx(seq, HOT / most, 10_000)).first()[0] if most > HOT else None
        first = rest if cut is None else rest.filter(seq <= cut)
        new = written(_followed(first, r, lead, strict).filter("key = leader").select("key", "mx", "my"), "leaders")
        lead = new if lead is None else lead.unionByName(new)
        if cut is None:
            break
        rest = written(apart(rest.filter(seq > cut), new, r, strict), "uncovered")
        most = _most(rest, r)
    return near(points, lead, r, strict).groupBy(F.col("a").alias("key")).agg(F.min("b").alias("leader"))


def markers(points: DataFrame, r: float) -> DataFrame:
    """(leader, n, x, y): marker clusters of points (seq, mx, my): each joins the nearest earlier leader nearer than r, or leads.

    A cluster stands where its first point stands. Of equally near leaders the first is joined.
    """
    distinct = written(collapsed(points), "points")
    lead = leaders(distinct, r, strict=True).filter("key = leader").select("key")
    centres = written(distinct.join(lead, "key").select("key", "mx", "my"), "centres")
    rows = points.select(F.col("seq").alias("key"), "mx", "my")
    nearest = near(rows, centres, r, strict=True).filter("b <= a").groupBy("a").agg(F.min(F.struct("d", "b")).alias("to"))
    grouped = nearest.groupBy(F.col("to.b").alias("leader")).agg(F.count("*").alias("n"))
    return grouped.join(centres.select(F.col("key").alias("leader"), F.col("mx").alias("x"), F.col("my").alias("y")), "leader")


def merged(points: DataFrame, member: DataFrame) -> DataFrame:
    """Clusters (key, mx, my, n, sx, sy, lx, ly, children): sums, centroid and the leader's own position; key is the leader's."""
    lead = points.select(F.col("key").alias("leader"), F.col("mx").alias("lx"), F.col("my").alias("ly"))
    grouped = points.join(member, "key").groupBy("leader").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.count("*").alias("children"))
    return grouped.join(lead, "leader").select(F.col("leader").alias("key"), (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"), "n", "sx", "sy", "lx", "ly", "children")


def collapsed(points: DataFrame) -> DataFrame:
    """points (seq, mx, my) as (key, mx, my, n, sx, sy): coinciding points are one, of the least seq."""
    grouped = points.groupBy("mx", "my", set_of(F.col("seq")).alias("set")).agg(F.min("seq").alias("key"), F.count("*").alias("n"))
    return grouped.select("key", "mx", "my", "n", (F.col("mx") * F.col("n")).alias("sx"), (F.col("my") * F.col("n")).alias("sy"))


def clusters_at(points: DataFrame, zoom: int) -> DataFrame:
    """Clusters of one zoom, straight from points (seq, mx, my)."""
    points = written(collapsed(points), "points")
    return merged(points, leaders(points, radius(zoom)))


_CLUSTER = ("key", "mx", "my", "n", "sx", "sy", "lx", "ly", "children", "expansion_zoom", "low", "high", "mean")


def _level(rows: DataFrame, zoom: int) -> DataFrame:
    """The clusters of a level from the rows of points with their leader; nothing is said of the distances between points."""
    sums = rows.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.max("px").alias("lx"), F.max("py").alias("ly"), F.count("*").alias("children"), F.min("expansion_zoom").alias("least"))
    expansion = F.when(F.col("children") == 1, F.col("least")).otherwise(F.lit(zoom + 1)).alias("expansion_zoom")
    none = (F.lit(None).cast("double").alias(c) for c in ("low", "high", "mean"))
    return sums.select(F.col("leader").alias("key"), (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"), "n", "sx", "sy", "lx", "ly", "children", expansion, *none)


def _root(rows: DataFrame, zoom: int) -> DataFrame:
    """The clusters of the last level, which nothing is asked of, from the rows of the level above with their leader."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        n, sx, sy = (float(np.add.reduce(t.column(c).to_numpy())) for c in ("n", "sx", "sy"))
        k, (low, high, mean) = len(t), _spread(np.zeros(len(t), np.int64), t.column("mx").to_numpy(), t.column("my").to_numpy(), 1)
        far = [None if k == 1 else float(v[0]) for v in (low, high, mean)]
        values = [t.column("leader")[0].as_py(), sx / n, sy / n, int(n), sx, sy, t.column("px")[0].as_py(), t.column("py")[0].as_py(), k, t.column("expansion_zoom")[0].as_py() if k == 1 else zoom + 1, *far]
        return pa.table({c: pa.array([v], kind) for c, v, kind in zip(_CLUSTER, values, [pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int32(), *[pa.float64()] * 3])})

    kinds = "key long, mx double, my double, n long, sx double, sy double, lx double, ly double, children long, expansion_zoom int, low double, high double, mean double"
    return rows.select("leader", "key", "px", "py", "mx", "my", "n", "sx", "sy", "expansion_zoom").groupBy("leader").applyInArrow(merge, kinds)


_KINDS = {"key": "long", "n": "long", "children": "long", "leader": "long", "expansion_zoom": "int", "late": "boolean"}


def _stored(spark: SparkSession, root: str, min_zoom: int) -> DataFrame:
    """The tree in a folder of levels."""
    kinds = ", ".join(f"{c} {_KINDS.get(c, 'double')}" for c in (*_CLUSTER, "leader", "px", "py", "late"))
    tree = spark.read.schema(f"{kinds}, level int").parquet(root).filter(F.col("leader").isNotNull() | (F.col("level") == min_zoom))
    return tree.select("level", "key", F.col("leader").alias("parent"), *_CLUSTER[1:], "px", "py", "late")


def _store_last(last: DataFrame, root: str, min_zoom: int) -> None:
    none = [F.lit(None).cast(_KINDS.get(c, "double")).alias(c) for c in ("leader", "px", "py", "late")]
    written(last.select(*_CLUSTER, *none), "level", f"{root}/level={min_zoom}")


def below(level: DataFrame, zoom: int, min_zoom: int = MIN_ZOOM, root: str | None = None) -> DataFrame:
    """The rows of hierarchy() for a level (as _level() gives it) and all below, which are clustered anew: one table, partitioned by level."""
    spark = level.sparkSession
    root = root or place(spark, "tree")
    if zoom == min_zoom:
        last = level
    else:
        rows = _followed(level, radius(zoom - 1), path=f"{root}/level={zoom}")
        for lower in range(zoom - 1, min_zoom, -1):
            rows = _risen(rows, lower, f"{root}/level={lower}")
        last = _root(rows, min_zoom)
    _store_last(last, root, min_zoom)
    return _stored(spark, root, min_zoom)


def hierarchy(points: DataFrame, max_zoom: int = MAX_ZOOM, min_zoom: int = MIN_ZOOM) -> DataFrame:
    """Clusters of all levels of points (seq, mx, my), as a table in the shared folder, partitioned by level.

    (level, key, parent, mx, my, n, sx, sy, lx, ly, children, expansion_zoom, low, high, mean, px, py, late): parent is the
    key of the cluster that holds it one level lower (null at min_zoom), px and py its leader's place, late whether its
    parent was found in a later round; a key names a cluster within its level and is the seq of its
    first point. expansion_zoom is that of the only child, or else the level above; low, high and mean are those of the
    distances between each two children (null for one child, and at max_zoom). An empty table gives an empty table.
    """
    nodes = written(collapsed(points).withColumn("expansion_zoom", F.lit(max_zoom + 1)), "points")
    r = radius(max_zoom)
    if _most(nodes, r) <= HOT:
        rows = _followed(nodes, r)
    else:
        rows = nodes.join(leaders(nodes, r), "key")
        rows = rows.join(nodes.select(F.col("key").alias("leader"), F.col("mx").alias("px"), F.col("my").alias("py")), "leader")
    tree = below(_level(rows, max_zoom), max_zoom, min_zoom)
    removed(nodes)
    removed(rows)
    return tree


def grown(tree: DataFrame | None, points: DataFrame, max_zoom: int = MAX_ZOOM, min_zoom: int = MIN_ZOOM, share: float = 0.1) -> DataFrame:
    """Exact incremental step over all levels: more points (seq beyond all earlier ones) enter at max_zoom, where leaders
    keep their places, and lower levels follow by changed regions.

    Level by level, the tiles that see a changed, new or vanished cluster follow the rule anew, all others keep what they
    had, for a decision hangs on a tile's view only; then only clusters with another or changed member are merged again,
    and what comes out as before changes nothing further down. So shuffled rows grow with the change; unchanged rows are
    copied without a shuffle. A level where over share of the clusters changed, and all below it, is clustered as in hierarchy();
    so is one that needed more than a round. Equal to hierarchy() of all points, but that children at max_zoom counts
    coinciding points of several steps apart. tree: a result of hierarchy() or grown(), None starts anew.
    """
    if tree is None:
        return hierarchy(points, max_zoom, min_zoom)
    spark, root = points.sparkSession, place(points.sparkSession, "tree")
    zoom = max_zoom
    old = tree.filter(F.col("level") == zoom)
    changed = _gains(old, points, zoom).withColumn("expansion_zoom", F.lit(zoom + 1))
    changed = changed.withColumns({c: F.lit(None).cast("double") for c in ("low", "high", "mean")})
    changed = written(changed.select(*_CLUSTER), "changed")
    gone = spark.createDataFrame([], "key long")
    while zoom > min_zoom:
        touched = changed.select("key").unionByName(gone)
        now = old.select(*_CLUSTER, "parent", "px", "py", "late").join(touched, "key", "left_anti")
        was = old.join(touched, "key").select("key", F.col("parent").alias("was"), F.col("mx").alias("wx"), F.col("my").alias("wy"))
        was = written(was, "was")
        if changed.count() > share * old.count() or old.filter("late").limit(1).count():
            return _grown_whole(now, changed, zoom, min_zoom, root)
        r = radius(zoom - 1)
        spots = changed.select("mx", "my").unionByName(was.select(F.col("wx").alias("mx"), F.col("wy").alias("my")))
        tiles = written(_dealt(spots, r).select("ti", "tj").distinct(), "tiles")
        current = now.drop("parent", "px", "py", "late").unionByName(changed)
        left = spark.sparkContext.accumulator(0)
        dealt = _dealt(current, r).withColumn("lead", F.lit(False)).join(tiles, ["ti", "tj"], "left_semi")
        again = written(_decided(dealt, r, False, left), "again")
        if left.value:
            return _grown_whole(now, changed, zoom, min_zoom, root)
        before = now.select("key", F.col("parent").alias("was")).unionByName(was.select("key", "was"))
        outcome = again.select("key", "leader").join(before, "key", "left").join(changed.select("key", F.lit(True).alias("new")), "key", "left")
        outcome = outcome.filter(F.col("new") | ~F.col("leader").eqNullSafe(F.col("was")))
        parents = outcome.select(F.explode(F.array("leader", "was")).alias("key")).unionByName(was.select(F.col("was").alias("key"))).filter("key is not null").distinct()
        parents = written(parents, "parents")
        kept = now.join(again.select("key"), "key", "left_anti").withColumnRenamed("parent", "leader")
        level = written(kept.unionByName(again.withColumn("late", F.lit(False))).select(*_CLUSTER, "leader", "px", "py", "late"), "level", f"{root}/level={zoom}")
        zoom -= 1
        old = tree.filter(F.col("level") == zoom)
        merged_ = written(_root(level.join(parents.select(F.col("key").alias("leader")), "leader"), zoom), "merged")
        gone = written(parents.join(merged_.select("key"), "key", "left_anti"), "gone")
        same = old.select(F.struct(*_CLUSTER).alias("had"), "key")
        changed = merged_.join(same, "key", "left").filter(~F.col("had").eqNullSafe(F.struct(*_CLUSTER))).select(*_CLUSTER)
        changed = written(changed, "changed")
    touched = changed.select("key").unionByName(gone)
    _store_last(old.select(*_CLUSTER).join(touched, "key", "left_anti").unionByName(changed), root, min_zoom)
    return _stored(spark, root, min_zoom)


def _grown_whole(now: DataFrame, changed: DataFrame, zoom: int, min_zoom: int, root: str) -> DataFrame:
    """The tree of a level's unchanged and changed clusters, with all levels below it clustered anew."""
    return below(now.select(*_CLUSTER).unionByName(changed), zoom, min_zoom, root)


def with_ids(tree: DataFrame, zoom: int) -> DataFrame:
    """Clusters of a level with id: the number in the order of keys and the zoom, in one long."""
    return numbered(tree.filter(F.col("level") == zoom), F.asc("key"), name="_index").withColumn("id", node_id(F.col("_index"), zoom)).drop("_index")


def labels_at(points: DataFrame, tree: DataFrame, zooms: Iterable[int], top: int) -> DataFrame:
    """(seq, tid, l4, l5, ...) of points (seq, tid, mx, my): the keys of each point's clusters at zooms of its tree, of which
    top is the last level.

    Clusters get the keys of those that hold them from the lowest zoom up, so the first joins are small.
    """
    zooms, at = sorted(zooms), None
    for level in range(zooms[0], top + 1):
        nodes = tree.filter(F.col("level") == level)
        at = nodes.select("key") if at is None else nodes.select("key", "parent").join(at.withColumnRenamed("key", "parent"), "parent").drop("parent")
        if level in zooms:
            at = at.withColumn(f"l{level}", F.col("key"))
    places = written(collapsed(points).select("key", "mx", "my"), "places")
    known = places.join(leaders(places, radius(top)), "key").join(at.withColumnRenamed("key", "leader"), "leader").drop("leader")
    known = known.withColumn("set", set_of(F.col("key"))).drop("key")
    return points.withColumn("set", set_of(F.col("seq"))).join(known, ["mx", "my", "set"]).select("seq", "tid", *(f"l{z}" for z in zooms))


def labels(points: DataFrame, tree: DataFrame, zoom: int, top: int | None = None) -> DataFrame:
    """(seq, tid, label) of points (seq, tid, mx, my): the key of each point's cluster at a zoom of its tree. top: the tree's
    last level (asked of it if not given)."""
    if top is None:
        top = tree.agg(F.max("level")).first()[0]
    return labels_at(points, tree, [zoom], top).withColumnRenamed(f"l{zoom}", "label")


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the leftmost."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def hulls(points: DataFrame, parts: int = 32) -> DataFrame:
    """(label, left, top, right, bottom, hull) of points (label, seq, mx, my): bounds and convex hull of each cluster.

    Parts of a cluster are reduced to the corners of their hulls first, so that no task sees a large cluster whole.
    """
    schema = "label long, part int, mx double, my double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _hull([*zip(pdf["mx"], pdf["my"])])
        return pd.DataFrame({"label": pdf["label"].iloc[0], "part": 0, "mx": [x for x, _ in found], "my": [y for _, y in found]})

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _hull([*zip(pdf["mx"], pdf["my"])])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "hull": [[[x, y] for x, y in found]]})

    bounds = points.groupBy("label").agg(F.min("mx").alias("left"), F.min("my").alias("top"), F.max("mx").alias("right"), F.max("my").alias("bottom"))
    dealt = points.select("label", F.expr(f"cast(pmod(xxhash64(seq), {parts}) as int)").alias("part"), "mx", "my")
    found = dealt.groupBy("label", "part").applyInPandas(corners, schema).groupBy("label").applyInPandas(ring, "label long, hull array<array<double>>")
    return bounds.join(found, "label")


def _gains(level: DataFrame, points: DataFrame, zoom: int) -> DataFrame:
    """The clusters of a level that more points (seq beyond all earlier ones) change or make, as they are then."""
    points = written(collapsed(points), "points")
    fixed = level.select("key", F.col("lx").alias("mx"), F.col("ly").alias("my"))
    member = written(leaders(points, radius(zoom), fixed), "members")
    gained = points.join(member, "key").groupBy(F.col("leader").alias("key")).agg(F.sum("n").alias("gn"), F.sum("sx").alias("gx"), F.sum("sy").alias("gy"), F.count("*").alias("gc"))
    old = level.join(gained, "key").select("key", *((F.col(a) + F.col(b)).alias(a) for a, b in (("n", "gn"), ("sx", "gx"), ("sy", "gy"), ("children", "gc"))), "lx", "ly")
    lead = points.join(level.select("key"), "key", "left_anti").select("key", F.col("mx").alias("lx"), F.col("my").alias("ly"))
    new = gained.join(lead, "key").select("key", F.col("gn").alias("n"), F.col("gx").alias("sx"), F.col("gy").alias("sy"), F.col("gc").alias("children"), "lx", "ly")
    return old.unionByName(new).select("key", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"), "n", "sx", "sy", "lx", "ly", "children")


def extended(level: DataFrame, points: DataFrame, zoom: int) -> DataFrame:
    """Exact incremental step: clusters of a zoom, straight from points, after more points (seq beyond all earlier ones).

    level is clusters_at()'s result so far. Stored leaders keep their places, since they come first; new points join the
    first of them within the radius, the rest cluster among themselves. Equal to clustering all points anew.
    """
    names = ["key", "mx", "my", "n", "sx", "sy", "lx", "ly", "children"]
    changed = written(_gains(level, points, zoom), "changed")
    return level.select(names).join(changed.select("key"), "key", "left_anti").unionByName(changed.select(names))


def approximate(state: DataFrame | None, points: DataFrame, max_zoom: int = MAX_ZOOM, min_zoom: int = MIN_ZOOM) -> DataFrame:
    """Approximate incremental step over all levels: leaders are never moved, and a point that joins a cluster at a level
    counts for all its ancestors without a search below.

    state and result: (level, key, parent, n, sx, sy, lx, ly); None starts anew. points: (seq, mx, my) after all earlier.
    """
    rows = written(collapsed(points), "points")
    rest = rows.select("key", "mx", "my")
    joins, news = None, None
    for zoom in range(max_zoom, min_zoom - 1, -1):
        level = state.filter(F.col("level") == zoom).select("key", F.col("lx").alias("mx"), F.col("ly").alias("my")) if state is not None else None
        member = written(leaders(rest, radius(zoom), level), "members")
        own = member.select(F.lit(zoom).alias("level"), "key", "leader")
        joins = own if joins is None else joins.unionByName(own)
        lead = rest.join(member.filter("key = leader").select("key"), "key", "left_semi")
        news = lead.withColumn("level", F.lit(zoom)) if news is None else news.unionByName(lead.withColumn("level", F.lit(zoom)))
        rest = written(lead, "rest")
    joins = written(joins, "joins")
    # A point's cluster at the levels below the one where it joined is its leader's ancestor there.
    up = news.select("level", "key").join(joins.select(F.col("level").alias("l"), "key", F.col("leader").alias("parent")), (F.col("l") == F.col("level") - 1) & (news.key == joins.key), "left").select("level", news.key, "parent")
    parents = up if state is None else up.unionByName(state.select("level", "key", "parent"))
    parents = written(parents, "parents")
    at = joins.filter(F.col("level") == max_zoom).select("key", F.col("leader").alias("node"))
    gains = None
    for zoom in range(max_zoom, min_zoom - 1, -1):
        gain = rows.join(at, "key").groupBy(F.col("node").alias("key")).agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).withColumn("level", F.lit(zoom))
        gains = gain if gains is None else gains.unionByName(gain)
        if zoom > min_zoom:
            step = parents.filter(F.col("level") == zoom).select(F.col("key").alias("node"), "parent")
            at = at.join(step, "node").select("key", F.col("parent").alias("node"))
    fresh = news.select("level", "key", F.col("mx").alias("lx"), F.col("my").alias("ly")).join(up, ["level", "key"]).withColumns({"n": F.lit(0).cast("long"), "sx": F.lit(0.0), "sy": F.lit(0.0)})
    names = ["level", "key", "parent", "n", "sx", "sy", "lx", "ly"]
    base = fresh.select(names) if state is None else fresh.select(names).unionByName(state.select(names))
    gains = gains.withColumnsRenamed({"n": "gn", "sx": "gx", "sy": "gy"})
    out = base.join(gains, ["level", "key"], "left")
    return written(out.select("level", "key", "parent", *((F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a) for a, b in (("n", "gn"), ("sx", "gx"), ("sy", "gy"))), "lx", "ly"), "state")
