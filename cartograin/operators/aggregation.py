"""Aggregation on screen: raw points, one point per pixel, quadtrees by cell keys, raster-aware sampling, heat bins."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mercator import boxes, within, within_any


def raw(points: DataFrame, bbox) -> DataFrame:
    """(seq, tid, x, y) of the points strictly inside a box in degrees."""
    return points.filter(within_any(F.col("mx"), F.col("my"), bbox)).select("seq", "tid", "x", "y")


def pixels(points: DataFrame, bbox, res_x: int, res_y: int) -> DataFrame:
    """(pi, pj, n, seq, x, y): for each pixel of a box in degrees with points, their number and the first by seq.

    Pixels divide the whole box, also one across the antimeridian, whose eastern part follows the western one.
    """
    parts = boxes(bbox)
    _, top, _, bottom = parts[0]
    width, before, inside, along = sum(p[2] - p[0] for p in parts), 0.0, None, None
    for part in parts:
        here = within(F.col("mx"), F.col("my"), part)
        at = F.col("mx") - F.lit(part[0]) + F.lit(before)
        inside, along = (here, at) if inside is None else (inside | here, F.when(here, at).otherwise(along))
        before += part[2] - part[0]
    found = points.filter(inside).withColumns({"pi": F.floor(along / (width / res_x)).cast("long"), "pj": F.floor((F.col("my") - top) / ((bottom - top) / res_y)).cast("long")})
    return found.groupBy("pi", "pj").agg(F.count("*").alias("n"), F.min_by(F.struct("seq", "x", "y"), "seq").alias("first")).select("pi", "pj", "n", "first.*")


def terminal_level(side: float) -> int:
    """The least level whose cells (of a unit square) are smaller than side."""
    level = 0
    while 2.0**-level >= side:
        level += 1
    return level


def cut_level(side: float) -> int:
    """The least level whose cells are of side at most."""
    level = 0
    while 2.0**-level > side:
        level += 1
    return level


def _cell(v: str, level: Column) -> Column:
    return F.floor(F.col(v) * F.pow(F.lit(2.0), level)).cast("long")


def cell_counts(points: DataFrame, terminal: int, first_level: int = 0) -> DataFrame:
    """(level, i, j, n, first): points of each quadtree cell, from first_level to the terminal level; points on the far edges are outside.

    Points are counted in cells of the terminal level, and only these counts go to the levels above.
    """
    inside = points.filter("mx >= 0 and mx < 1 and my >= 0 and my < 1")
    low = inside.groupBy(_cell("mx", F.lit(float(terminal))).alias("i"), _cell("my", F.lit(float(terminal))).alias("j")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    cells = low.withColumn("level", F.explode(F.sequence(F.lit(first_level), F.lit(terminal))))
    up = lambda c: F.expr(f"shiftright({c}, {terminal} - level)").alias(c)
    return cells.groupBy("level", up("i"), up("j")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _touching(bbox) -> Column:
    """Whether a cell (level, i, j) touches a box in the unit square, edges included."""
    left, top, right, bottom = bbox
    side = F.pow(F.lit(2.0), -F.col("level"))
    return (F.col("i") * side <= right) & ((F.col("i") + 1) * side >= left) & (F.col("j") * side <= bottom) & ((F.col("j") + 1) * side >= top)


def quadtree(points: DataFrame, bbox, terminal: int, cut: int) -> DataFrame:
    """(level, i, j, n, x, y, seq): what a walk of the quadtree down to a box yields.

    A cell with one point, or at the terminal level, gives its first point; a cell at the cut level gives its centre (seq
    -1); cells that do not touch the box are passed over. bbox is (left, top, right, bottom) in the unit square, edges
    included. n is the number of points in the cell. Points far from the box matter only through the counts of the cells
    above, so cells of the last level are taken with them.
    """
    last = min(terminal, cut)
    counts = cell_counts(points, last)
    ends = (F.col("n") == 1) | (F.col("level") == F.lit(last))
    seen = counts.filter(_touching(bbox))
    up = seen.select((F.col("level") + 1).alias("level"), F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("n").alias("pn"))
    found = seen.filter(ends).withColumns({"pi": F.shiftright("i", 1), "pj": F.shiftright("j", 1)}).join(up, ["level", "pi", "pj"], "left").filter("level = 0 or pn > 1")
    places = points.select(F.col("seq").alias("first"), F.col("mx"), F.col("my"))
    one = (F.col("n") == 1) | ((F.col("level") == terminal) & F.lit(terminal <= cut))
    side = F.pow(F.lit(2.0), -F.col("level"))
    return found.join(places, "first").select("level", "i", "j", "n", F.when(one, F.col("mx")).otherwise((F.col("i") + 0.5) * side).alias("x"), F.when(one, F.col("my")).otherwise((F.col("j") + 0.5) * side).alias("y"), F.when(one, F.col("first")).otherwise(F.lit(-1)).alias("seq"))


#: Pixels of a cell's raster on a side (with a margin of two on either side), and the disc's radius in pixels.
RASTER, DISC = 5, 1.0
#: Points of whole cells that a task draws at a time.
GATHER = 1 << 15


def _drawn(canvases: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Blends a blue anti-aliased disc at (u, v) in [0, 1) of each canvas's inner pixel into it; which canvases changed."""
    at = np.arange(RASTER) + 0.5
    margin = RASTER // 2
    d = np.hypot(at[None, None, :] - (margin + u)[:, None, None], at[None, :, None] - (margin + v)[:, None, None])
    t = np.clip((d - (DISC - 0.5)) / 1.0, 0.0, 1.0)
    alpha = (1.0 - t * t * (3.0 - 2.0 * t))[..., None]
    new = (canvases * (1.0 - alpha) + np.array([0.0, 0.0, 255.0]) * alpha).astype(np.uint8)
    changed = (new != canvases).any(axis=(1, 2, 3))
    canvases[:] = new
    return changed


def _folded(cell: np.ndarray, u: np.ndarray, v: np.ndarray, draw) -> np.ndarray:
    """Which points, in order within each run of equal cell, change their cell's raster: the k-th points of all cells are drawn at once."""
    starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
    sizes = np.diff(np.append(starts, len(cell)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    canvases = np.full((len(starts), RASTER, RASTER, 3), 255, np.uint8)
    keep, left = np.zeros(len(cell), bool), len(starts)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[left - 1] <= k:
            left -= 1
        row = starts[:left] + k
        keep[row] = draw(canvases[:left], u[row], v[row])
    return keep


def raster_samples(points: DataFrame, max_level: int, drawn_from: int = 3, draw=_drawn, part: int = 5000, bbox=None, cut: int | None = None) -> DataFrame:
    """(level, i, j, n, seq, mx, my): the samples of each quadtree cell: points whose drawing changes its raster, by seq.

    Cells exist while their parent has two points or more; levels below drawn_from keep the first point; the terminal level
    keeps all. draw(canvases, u, v) is the renderer: it draws a point on each canvas and returns which ones changed. It must only ever bring pixels
    nearer to a last value, so that what changes nothing on a canvas changes nothing on one with more drawn: then a hot
    cell is first thinned in parts of about so many points, and what the parts keep (bounded by the pixels' values) is
    drawn in order. With bbox (unit square) only cells that touch it, and with cut only levels down to it, are drawn.
    """
    counts = cell_counts(points, max_level)
    up = counts.filter("n > 1").select((F.col("level") + 1).alias("level"), F.col("i").alias("pi"), F.col("j").alias("pj"))
    cells = counts.withColumns({"pi": F.floor(F.col("i") / 2).cast("long"), "pj": F.floor(F.col("j") / 2).cast("long")})
    cells = cells.join(up, ["level", "pi", "pj"], "left_semi").unionByName(cells.filter("level = 0")).select("level", "i", "j", "n", "first")
    last = max_level if cut is None else min(cut, max_level)
    if bbox is not None:
        cells = cells.filter(_touching(bbox))
    if cut is not None:
        cells = cells.filter((F.col("level") == last) | ((F.col("level") < last) & (F.col("n") == 1)))
    held = points.filter("mx >= 0 and mx < 1 and my >= 0 and my < 1").select("seq", "mx", "my").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last))))
    held = held.withColumns({"i": _cell("mx", F.col("level")), "j": _cell("my", F.col("level"))}).join(cells, ["level", "i", "j"])
    few = held.filter((F.col("level") < drawn_from) & (F.col("seq") == F.col("first")))
    whole = held.filter((F.col("level") >= drawn_from) & ((F.col("level") == max_level) | (F.col("n") == 1)))
    many = held.filter((F.col("level") >= drawn_from) & (F.col("level") < max_level) & (F.col("n") > 1))
    names = ["level", "i", "j", "n", "seq", "mx", "my"]

    def fold(batches):
        def kept(rows: pa.Table) -> pa.Table:
            level, i, j, x, y, own = (rows.column(c).to_numpy() for c in ("level", "i", "j", "mx", "my", "part"))
            new = np.zeros(len(level), bool)
            for c in (level, i, j, own):
                new[1:] |= c[1:] != c[:-1]
            scale = 2.0**level
            return rows.filter(pa.array(_folded(np.cumsum(new), x * scale - i, y * scale - j, draw)))

        held, count = [], 0
        for b in chain(batches, (None,)):
            if b is not None:
                held.append(b)
                count += b.num_rows
                if count < GATHER:
                    continue
            if not count:
                continue
            rows = pa.Table.from_batches(held)
            ends = np.zeros(len(rows), bool)
            for c in ("level", "i", "j", "part"):
                own = rows.column(c).to_numpy()
                ends |= own != own[-1]
            cut = len(rows) if b is None else int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0  # the last cell may go on
            yield from kept(rows.slice(0, cut)).to_batches()
            held, count = rows.slice(cut).to_batches(), len(rows) - cut

    def drawn(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("level", "i", "j", "part").sortWithinPartitions("level", "i", "j", "part", "seq")
        return dealt.mapInArrow(fold, "level int, i long, j long, n long, seq long, mx double, my double, part int")

    many = many.select(*names, F.lit(0).alias("part"))
    hot = many.filter(F.col("n") > part).withColumn("part", F.expr(f"cast(pmod(xxhash64(seq), ceil(n / {part})) as int)"))
    drawn = drawn(drawn(hot).withColumn("part", F.lit(0)).unionByName(many.filter(F.col("n") <= part)))
    return few.select(names).unionByName(whole.select(names)).unionByName(drawn.select(names))


def raster_range(samples: DataFrame, bbox, cut: int) -> DataFrame:
    """(seq, mx, my): samples of the cells at the cut level, and of childless cells above it, that touch a box (unit square)."""
    return samples.filter((F.col("level") == cut) | ((F.col("level") < cut) & (F.col("n") == 1))).filter(_touching(bbox)).select("seq", "mx", "my").distinct()


def raster_statistics(samples: DataFrame) -> DataFrame:
    """(level, nodes, samples, least, most, mean) of the cells' sample counts; level null is all levels."""
    per = samples.groupBy("level", "i", "j").agg(F.count("*").alias("k"))
    return per.rollup("level").agg(F.count("*").alias("nodes"), F.sum("k").alias("samples"), F.min("k").alias("least"), F.max("k").alias("most"), F.avg("k").alias("mean"))


def raster_histogram(samples: DataFrame, bins: int = 100) -> DataFrame:
    """(level, bin, nodes): cells by their number of samples; the last bin holds all larger ones."""
    per = samples.groupBy("level", "i", "j").agg(F.count("*").alias("k"))
    return per.groupBy("level", F.least("k", F.lit(bins)).alias("bin")).agg(F.count("*").alias("nodes"))


def raster_histograms(samples: DataFrame, max_level: int, level: int, deep: int = 10, bins: int = 100) -> DataFrame:
    """(kind, bin, nodes): four histograms of the cells; the last bin holds all larger counts.

    inner: samples of cells with children beyond level deep; leaf: points of cells without; level: samples of the inner ones
    of one level; level_points: their points in bins of ten (none where that level isn't beyond deep).
    """
    per = samples.groupBy("level", "i", "j").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    leaf = (F.col("n") == 1) | (F.col("level") == max_level)
    inner = ~leaf & (F.col("level") > deep)
    at = inner & (F.col("level") == level)
    of = lambda kind, which, value: F.when(which, F.struct(F.lit(kind).alias("kind"), F.least(value, F.lit(bins)).cast("long").alias("bin")))
    kinds = F.array(of("inner", inner, F.col("k")), of("leaf", leaf, F.col("k")), of("level", at, F.col("k")), of("level_points", at, F.floor(F.col("n") / 10)))
    return per.select(F.explode(F.array_compact(kinds)).alias("h")).groupBy("h.kind", "h.bin").agg(F.count("*").alias("nodes"))


def heat(points: DataFrame, cell: float, weight: float = 1.0, most: float = 1.0, zoom: int | None = None, max_zoom: int = 18) -> DataFrame:
    """(ci, cj, x, y, w): weighted centroid and clamped weight of each square cell of points.

    A point counts weight times its intensity (column intensity, 1 where there is none), and at a zoom below max_zoom half
    as much for each level. Places are summed as decimals, so the result does not depend on the order of rows.
    """
    share = 1.0 if zoom is None else 1.0 / 2.0 ** max(0, min(max_zoom - zoom, 12))
    own = F.col("intensity").cast("decimal(18,6)") if "intensity" in points.columns else F.lit(1).cast("decimal(18,6)")
    place = lambda c: F.sum(F.col(c).cast("decimal(18,15)") * own)
    grouped = points.groupBy(F.floor(F.col("mx") / cell).cast("long").alias("ci"), F.floor(F.col("my") / cell).cast("long").alias("cj"))
    sums = grouped.agg(place("mx").alias("sx"), place("my").alias("sy"), F.sum(own).alias("k"))
    of = lambda c: (F.col(c).cast("double") / F.col("k").cast("double")).alias(c[1])
    return sums.select("ci", "cj", of("sx"), of("sy"), F.least(F.col("k").cast("double") * F.lit(weight * share), F.lit(most)).alias("w"))


def picked(points: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The point nearest to a place, if within reach (ties: least seq)."""
    d = F.sqrt(F.pow(F.col("mx") - x, F.lit(2.0)) + F.pow(F.col("my") - y, F.lit(2.0)))
    return points.withColumn("d", d).filter(F.col("d") <= reach).orderBy("d", "seq").limit(1)
