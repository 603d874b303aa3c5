"""Geo operators against plain restatements of their rules, and both strategies against each other."""

import gc
import json
import os
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograin.functions import mercator as m
from cartograin.functions.text_match import match
from cartograin.operators import aggregation, agreement, clustering, radius_join, visible
from cartograin.plans.session import Session, recorded
from cartograin.sources import points as sources
from cartograin.sources import sinks
from cartograin.streaming.progressive import Progressive


def greedy(points, r):
    """[(key, x, y, n)] in order: key to leader."""
    leads, of = [], {}
    for key, x, y, *_ in points:
        at = [k for k, a, b in leads if ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= r]
        of[key] = min(at, default=key)
        if not at:
            leads.append((key, x, y))
    return of


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(k, min(0.999, abs(rng.gauss(0.5, 0.1))), min(0.999, abs(rng.gauss(0.4, 0.1)))) for k in range(250)]
    return out + [(250 + k, *out[k * 3][1:]) for k in range(20)]


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame([(k, k, (x - 0.5) * 360, 0.0, x, y) for k, x, y in rows], "seq long, tid long, x double, y double, mx double, my double")


def unit_grid(spark):
    return spark.createDataFrame([(100 * j + i, float(i), float(j)) for i in range(12) for j in range(12)], "key long, mx double, my double")


@pytest.mark.parametrize("x,y,r,n", [(3.0, 3.0, 1.5, 9), (0.0, 0.0, 3.5, 13)])
def test_radius(spark, x, y, r, n):
    centre = spark.createDataFrame([(0, x, y)], "key long, mx double, my double")
    assert radius_join.near(unit_grid(spark), centre, r).count() == radius_join.near(centre, unit_grid(spark), r).count() == n


@pytest.mark.parametrize("box,n", [((1.5, 1.5, 4.5, 4.5), 9), ((-1.0, -1.0, 1.5, 2.8), 6), ((1.0, 1.0, 4.0, 4.0), 4)])
def test_strict_box(spark, box, n):
    assert unit_grid(spark).filter(m.within(F.col("mx"), F.col("my"), box)).count() == n


def test_projection(spark):
    df = spark.createDataFrame([(-180.0, 90.0), (0.0, 0.0), (180.0, -90.0), (10.0, 45.0), (5.0, 91.0)], "lng double, lat double")
    got = df.select(m.lng_x(F.col("lng")), m.lat_y(F.col("lat")), m.y_lat(m.lat_y(F.col("lat")))).collect()
    assert [tuple(r)[:2] for r in got[:3]] == [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)] and abs(got[3][2] - 45) < 1e-9 and got[4][1] == 0.0
    assert abs(m.y_of(45.0) - got[3][1]) < 1e-12
    assert len(m.boxes((170, -10, -170, 10))) == 2 and m.boxes((-200, -95, 200, 95)) == [(0.0, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("hot", [20_000, 30])
@pytest.mark.parametrize("tile", [32, 9])
def test_leaders_follow_the_greedy_rule(points, rows, hot, tile, monkeypatch):
    monkeypatch.setattr(clustering, "HOT", hot)
    monkeypatch.setattr(clustering, "TILE", tile)
    distinct = clustering.collapsed(points)
    got = {r.key: r.leader for r in clustering.leaders(distinct, 0.05).collect()}
    seen = {}
    for k, x, y in rows:
        seen.setdefault((x, y), k)
    assert got == greedy([(k, x, y) for (x, y), k in seen.items()], 0.05)


@pytest.mark.parametrize("hot", [20_000, 30])
def test_hierarchy(points, rows, hot, monkeypatch):
    monkeypatch.setattr(clustering, "HOT", hot)
    tree = clustering.hierarchy(points, 4, 2).collect()
    seen = {}
    for k, x, y in rows:
        seen.setdefault((x, y), [k, 0])[1] += 1
    nodes = sorted((k, x, y, n, x * n, y * n) for (x, y), (k, n) in seen.items())
    for zoom in (4, 3, 2):
        of, level = greedy(nodes, m.radius(zoom)), {}
        for key, x, y, n, sx, sy in nodes:
            at = level.setdefault(of[key], [0, 0.0, 0.0, 0])
            at[0], at[1], at[2], at[3] = at[0] + n, at[1] + sx, at[2] + sy, at[3] + 1
        got = {r.key: r for r in tree if r.level == zoom}
        assert {k: (r.n, r.children) for k, r in got.items()} == {k: (v[0], v[3]) for k, v in level.items()}
        assert all(abs(r.mx - level[k][1] / level[k][0]) < 1e-12 for k, r in got.items()) and sum(r.n for r in got.values()) == len(rows)
        if zoom < 4:
            assert {r.key: r.parent for r in tree if r.level == zoom + 1} == of
        nodes = sorted((k, v[1] / v[0], v[2] / v[0], v[0], v[1], v[2]) for k, v in level.items())


@pytest.mark.parametrize("hot", [20_000, 30])
def test_incremental_is_exact(points, hot, monkeypatch):
    monkeypatch.setattr(clustering, "HOT", hot)
    whole = {(r.key, r.n, round(r.mx, 9)) for r in clustering.clusters_at(points, 3).collect()}
    state = clustering.clusters_at(points.filter("seq < 100"), 3)
    state = clustering.extended(state, points.filter("seq >= 100 and seq < 200"), 3)
    assert {(r.key, r.n, round(r.mx, 9)) for r in clustering.extended(state, points.filter("seq >= 200"), 3).collect()} == whole


def test_incremental_over_all_levels_is_exact(points):
    of = lambda tree: {(r.level, r.key, r.parent, r.n, r.children if r.level < 4 else None, round(r.mx, 9)) for r in tree.collect()}
    tree = clustering.grown(clustering.grown(None, points.filter("seq < 120"), 4, 1), points.filter("seq >= 120"), 4, 1)
    assert of(tree) == of(clustering.hierarchy(points, 4, 1))


def test_changed_regions(points, monkeypatch):
    """Steps of very different sizes, followed by changed regions, are equal to clustering all points at once."""
    monkeypatch.setattr(clustering, "TILE", 9)
    of = lambda tree: {(r.level, r.key, r.parent, r.n, r.children if r.level < 5 else None, r.expansion_zoom if r.level < 5 else None, *(None if v is None else round(v, 9) for v in (r.mx, r.my, r.lx, r.ly, r.high, r.low, r.mean))) for r in tree.collect()}
    tree, low = None, 0
    for high in (200, 201, 270):
        tree, low = clustering.grown(tree, points.filter(f"seq >= {low} and seq < {high}"), 5, 2, 1.0), high
    assert of(tree) == of(clustering.hierarchy(points, 5, 2))


def test_unchanged_tiles_are_not_followed_again(spark, points, rows, monkeypatch):
    """A point far from all others makes only its own tiles follow the rule."""
    tree = clustering.hierarchy(points, 5, 3)
    asked, decided = [], clustering._decided
    monkeypatch.setattr(clustering, "_decided", lambda dealt, *rest: asked.append(dealt.filter("own").count()) or decided(dealt, *rest))
    far = spark.createDataFrame([(270, 270, 0.0, 0.0, 0.97, 0.97)], "seq long, tid long, x double, y double, mx double, my double")
    got = clustering.grown(tree, far, 5, 3, 1.0)
    assert asked[1:] == [1, 1]  # the new point enters first, then once a level
    want = clustering.hierarchy(points.select("seq", "tid", "x", "y", "mx", "my").unionByName(far), 5, 3)
    of = lambda tree: {(r.level, r.key, r.parent, r.n) for r in tree.collect()}
    assert of(got) == of(want)


def test_golden_sizes_of_levels(spark, small):
    p = sources.ordered(sources.projected(sources.from_events(spark, small)))
    got = {r.level: r["count"] for r in clustering.hierarchy(p).groupBy("level").count().collect()}
    assert [got[z] for z in range(10, -1, -1)] == [974, 874, 581, 257, 92, 29, 13, 6, 3, 2, 1] and got[17] == got[11] == 1000


def test_approximate_conserves_points(points, rows):
    state = clustering.approximate(None, points.filter("seq < 120"), 3, 1)
    state = clustering.approximate(state, points.filter("seq >= 120"), 3, 1).collect()
    for zoom in (3, 2, 1):
        assert sum(r.n for r in state if r.level == zoom) == len(rows)
    keys = {(r.level, r.key) for r in state}
    assert len(keys) == len(state) and all((r.level - 1, r.parent) in keys for r in state if r.level > 1)


def test_approximate_against_a_plain_restatement(points, rows):
    """Point by point: at each level the point joins the first leader within the radius, and counts for all its ancestors, or leads and goes on below."""
    state, low, cuts = None, 0, (90, 91, 270)
    for high in cuts:
        state, low = clustering.approximate(state, points.filter(f"seq >= {low} and seq < {high}"), 4, 1), high
    first = {}
    for k, x, y in rows:
        first.setdefault(((k >= cuts[0]) + sum(k >= c for c in cuts[1:]), x, y), [k, 0])[1] += 1  # coinciding points of a batch are one
    nodes, parents = {}, {}
    for (_, x, y), (k, n) in sorted(first.items(), key=lambda item: item[1]):
        below, level = None, 4
        while level >= 1:
            at = min([key for (z, key), v in nodes.items() if z == level and ((x - v[0]) ** 2 + (y - v[1]) ** 2) ** 0.5 <= m.radius(level)], default=None)
            if at is None:
                nodes[level, k] = [x, y, 0]
                if below:
                    parents[below] = k
                below = (level, k)
                level -= 1
                continue
            if below:
                parents[below] = at
            break
        top = (4, k) if (4, k) in nodes else (4, at if level == 4 else k)
        while top[0] >= 1:
            nodes[top][2] += n
            top = (top[0] - 1, parents.get(top))
    got = {(r.level, r.key): (round(r.lx, 12), round(r.ly, 12), r.n, r.parent) for r in state.collect()}
    assert got == {k: (round(x, 12), round(y, 12), n, parents.get(k)) for k, (x, y, n) in nodes.items()}


def test_labels_and_indexes(points, rows):
    tree = clustering.hierarchy(points, 4, 2)
    got = clustering.labels(points, tree, 2)
    sizes = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sizes == {r.key: r.n for r in tree.filter("level = 2").collect()}
    same = agreement.rand_indexes(agreement.aligned(got, got)).first()
    assert same.rand == 1.0 and same.adjusted_rand == 1.0


def quadtree(rows, box, terminal, cut):
    out = set()

    def walk(level, i, j, own):
        side = 2.0**-level
        if not own or i * side > box[2] or (i + 1) * side < box[0] or j * side > box[3] or (j + 1) * side < box[1]:
            return
        if len(own) == 1 or level == terminal:
            out.add((level, min(own)[0]))
        elif level == cut:
            out.add((level, i, j))
        else:
            for a in (0, 1):
                for b in (0, 1):
                    walk(level + 1, 2 * i + a, 2 * j + b, [p for p in own if int(p[1] * 2 ** (level + 1)) == 2 * i + a and int(p[2] * 2 ** (level + 1)) == 2 * j + b])

    walk(0, 0, 0, rows)
    return out


@pytest.mark.parametrize("terminal,cut", [(9, 5), (5, 9), (12, 12), (4, 4)])
def test_quadtree(points, rows, terminal, cut):
    box = (0.3, 0.3, 0.55, 0.45)
    got = aggregation.quadtree(points, box, terminal, cut).collect()
    assert {(r.level, r.seq) if r.seq >= 0 else (r.level, r.i, r.j) for r in got} == quadtree(rows, box, terminal, cut) and len(got) == len(quadtree(rows, box, terminal, cut))


@pytest.mark.parametrize("part", [5000, 7])
def test_raster_samples(points, rows, part):
    got = {}
    for r in aggregation.raster_samples(points, 6, part=part).collect():
        got.setdefault((r.level, r.i, r.j), set()).add(r.seq)

    def walk(level, i, j, own):
        if not own:
            return
        if level < 3:
            want = {own[0][0]}
        elif level == 6 or len(own) == 1:
            want = {p[0] for p in own}
        else:
            canvas, want = np.full((1, aggregation.RASTER, aggregation.RASTER, 3), 255, np.uint8), set()
            for k, x, y in own:
                if aggregation._drawn(canvas, np.array([x * 2**level - i]), np.array([y * 2**level - j]))[0]:
                    want.add(k)
        assert got.pop((level, i, j)) == want
        if len(own) > 1 and level < 6:
            for a in (0, 1):
                for b in (0, 1):
                    walk(level + 1, 2 * i + a, 2 * j + b, [p for p in own if int(p[1] * 2 ** (level + 1)) == 2 * i + a and int(p[2] * 2 ** (level + 1)) == 2 * j + b])

    walk(0, 0, 0, rows)
    assert not got


def test_tree_cut(points):
    tree = clustering.hierarchy(points, 4, 1)
    frontier = tree.filter("level = 1")
    nodes = {(r.level, r.key): r for r in tree.collect()}
    kids = {}
    for r in nodes.values():
        kids.setdefault((r.level - 1, r.parent), []).append(r)
    for measure, fold in (("max", max), ("min", min), ("avg", lambda v: sum(v) / len(v))):
        want, todo = set(), [r for r in nodes.values() if r.level == 1]
        while todo:
            r = todo.pop()
            own = kids.get((r.level, r.key), [])
            d = [((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) ** 0.5 for k, a in enumerate(own) for b in own[:k]]
            if len(own) == 1 or d and fold(d) >= 0.04:
                todo += own
            else:
                want.add((r.level, r.key))
        assert {(r.level, r.key) for r in visible.tree_cut(tree, frontier, 0.04, measure).collect()} == want


def test_bipartite_cut(points):
    tree = clustering.hierarchy(points, 5, 1)
    nodes = {(r.level, r.key): r for r in tree.collect()}
    kids = {}
    for r in nodes.values():
        kids.setdefault((r.level - 1, r.parent), []).append(r)

    def expands(r, d):
        own = kids.get((r.level, r.key), [])
        return len(own) == 1 or max([((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) ** 0.5 for k, a in enumerate(own) for b in own[:k]], default=-1) >= d

    for level, d in ((2, 0.04), (3, 0.02), (4, 0.01)):
        kept, todo = set(), [r for r in nodes.values() if r.level == level]
        while len(todo) > 3:
            todo.sort(key=lambda r: (-r.n, r.level, r.key))
            whole, k, run = sum(r.n for r in todo), 0, 0
            while 2 * run < whole:
                run += todo[k].n
                k += 1
            head, tail, largest = todo[:k], todo[k:], todo[0].n
            kept |= {(r.level, r.key) for r in head} | {(r.level, r.key) for r in tail if not expands(r, d)}
            todo = [c for r in tail if expands(r, d) for c in kids[r.level, r.key]]
            if largest <= 1:
                break
        got = visible.bipartite_cut(tree, tree.filter(F.col("level") == level), d)
        assert [{(r.level, r.key) for r in x.collect()} for x in got] == [kept, {(r.level, r.key) for r in todo}]
    whole = visible.cut(tree, (-180, -90, 180, 90), 3, 1.0, "max", True)
    assert sum(r.n for r in whole.collect()) == sum(r.n for r in nodes.values() if r.level == 3)


def test_level_batches(points, rows):
    """Against a plain restatement: each level's moves are judged on one state."""
    from cartograin.operators import incremental

    def dist(a, b):
        return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5

    def first(leads, xy, r):
        return min([k for k, p in leads.items() if dist(p, xy) <= r], default=None)

    def step(state, batch, high, low, miu):
        level = {k: dict(v) for k, v in state.get(high, {}).items()}
        places = {k: v["at"] for k, v in level.items()}
        for k, x, y in batch:
            lead = first(places, (x, y), m.radius(high))
            if lead is None:
                lead, places[k] = k, (x, y)
                level[k] = {"at": (x, y), "n": 0, "sx": 0.0, "sy": 0.0, "up": None}
            v = level[lead]
            v["n"], v["sx"], v["sy"] = v["n"] + 1, v["sx"] + x, v["sy"] + y
        out = {}
        for z in range(high, low, -1):
            r, old = m.radius(z - 1), state.get(z - 1, {})
            mid = {k: (v["sx"] / v["n"], v["sy"] / v["n"]) for k, v in level.items()}
            drifted = {k for k, v in level.items() if v["up"] is not None and dist(mid[k], v["at"]) > miu * r}
            anchors = {k: mid[k] if k in drifted and level[k]["up"] == k else v["at"] for k, v in old.items()}
            moved = {k for k in drifted if level[k]["up"] == k}
            for k in drifted:
                level[k]["at"] = mid[k]
            for k, v in level.items():
                if v["up"] is None or v["up"] == k:
                    continue
                taker, was = first({a: anchors[a] for a in moved}, mid[k], r), v["up"]
                if taker is not None and taker < was:
                    v["up"] = taker
                elif (was in moved or k in drifted) and dist(mid[k], anchors[was]) > r:
                    v["up"] = None
            leads = dict(anchors)
            for k in sorted(k for k, v in level.items() if v["up"] is None):
                lead = first(leads, mid[k], r)
                if lead is None:
                    lead, leads[k] = k, mid[k]
                level[k]["up"] = lead
            out[z], up = level, {}
            for k, v in level.items():
                u = up.setdefault(v["up"], {"at": leads[v["up"]], "n": 0, "sx": 0.0, "sy": 0.0, "up": old.get(v["up"], {}).get("up")})
                u["n"], u["sx"], u["sy"] = u["n"] + v["n"], u["sx"] + v["sx"], u["sy"] + v["sy"]
            level = up
        out[low] = level
        return out

    state, want, seen = None, {}, {}
    for low, high in ((0, 60), (60, 130), (130, 270)):
        batch = [p for p in rows if low <= p[0] < high]
        own = {}
        for k, x, y in batch:
            own.setdefault((x, y), k)
        want = step(want, [(own[x, y], x, y) for k, x, y in batch], 5, 1, 0.2)
        state = incremental.level_batch(state, points.filter(F.col("seq").between(low, high - 1)), 5, 1, 0.2)
        got = {(r.level, r.key): (r.n, r.parent) for r in state.collect()}
        assert got == {(z, k): (v["n"], v["up"]) for z, level in want.items() for k, v in level.items()}
        assert all(sum(n for (z, _), (n, _) in got.items() if z == level) == high for level in range(1, 6))
    assert any(v["at"] != (0, 0) and v["n"] > 1 for v in want[1].values())


def test_pixels_across_the_antimeridian(spark):
    at = spark.createDataFrame([(k, k, x, 0.0, (x + 180) / 360, 0.5) for k, x in enumerate((171.0, 176.0, -179.0, -171.0, 0.0))], "seq long, tid long, x double, y double, mx double, my double")
    assert sorted((r.pi, r.n, r.seq) for r in aggregation.pixels(at, (170, -10, -170, 10), 4, 2).collect()) == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3)]


def test_heat_weights(spark):
    at = spark.createDataFrame([(0.11, 0.21, 2.0), (0.12, 0.22, 1.0), (0.9, 0.9, 5.0)], "mx double, my double, intensity double")
    got = {(r.ci, r.cj): (round(r.x, 9), round(r.y, 9), r.w) for r in aggregation.heat(at, 0.1, 0.5, 2.0).collect()}
    assert got == {(1, 2): (round(0.34 / 3, 9), round(0.64 / 3, 9), 1.5), (9, 9): (0.9, 0.9, 2.0)}
    assert {r.w for r in aggregation.heat(at.drop("intensity"), 0.1, 1.0, 9.0, zoom=17).collect()} == {1.0, 0.5}


@pytest.mark.parametrize("query,want", [("cat", [1, 3]), ("cat & dog", [3]), ("cat | bird", [1, 2, 3]), ("!cat", [2, 4]), ("(cat | bird) & !dog", [1, 2]), ("ca:*", [1, 3]), ("big <-> dog", [3]), ("big <-> cat", []), ("cat &", []), (None, [1, 2, 3, 4]), ("%", [1, 2, 3, 4])])
def test_keyword_queries(spark, query, want):
    docs = spark.createDataFrame([(1, "A Cat."), (2, "bird"), (3, "cat, big DOG"), (4, None)], "id long, text string")
    assert sorted(r.id for r in docs.filter(match(F.col("text"), query)).collect()) == want


def test_orders(spark, points, rows):
    got = {r.tid: r.seq for r in sources.ordered(points.drop("seq"), "reverse-spatial").collect()}
    want = sorted(rows, key=lambda p: (-(p[1] - 0.5) * 360, p[0]))
    assert got == {p[0]: k for k, p in enumerate(want)}
    with pytest.raises(ValueError):
        sources.ordered(points, "sideways")


def test_slices():
    out = [*sources.slices(datetime(2024, 1, 1), datetime(2024, 1, 8), 3)]
    assert [x[3] for x in out] == [42, 85, 100] and out[-1][2] == datetime(2024, 1, 8)


def test_sinks(spark):
    df = spark.createDataFrame([(1, 2, 3, 10.0, 20.0)], "key long, level int, n long, lng double, lat double")
    feature = json.loads(sinks.geojson(df).first().feature)
    assert feature["geometry"]["coordinates"] == [10.0, 20.0] and feature["properties"]["point_count"] == 3
    head, body = sinks.unframe(sinks.frame(df, 50, 1.0, 2.0, 3.0))
    assert head == (50, 1.0, 2.0, 3.0) and body.tolist() == [(20.0, 10.0, 3)]


def test_session_and_stream(spark, small, tmp_path):
    events = sources.from_events(spark, small)
    session = Session(events, max_zoom=6)
    box = (-130.0, 20.0, -60.0, 50.0)
    n = events.filter("text = 'click'").count()
    assert session.query("click", box, 2).agg(F.sum("n")).first()[0] == n == session.query("click", box, 2, tree_cut=True).agg(F.sum("n")).first()[0]
    assert session.query("click", box, 2, "DE").count() == n and session.query("click", box, 2, "DA").agg(F.sum("n")).first()[0] == n
    assert session.query("click", box, 2, "QTA").count() > 0 and session.query("click", box, 2, "GQTA").count() > 0
    events.filter("text = 'click'").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress = Progressive(spark, zoom=3)
    progress.run(stream, f"{tmp_path}/at").awaitTermination()
    assert progress.state.agg(F.sum("n")).first()[0] == n and progress.last >= 1
    progress.update(events.limit(5), 0)
    assert progress.seen == n


def test_stream_goes_on_after_a_restart(spark, small, tmp_path):
    events = sources.from_events(spark, small)
    halves = [events.filter("tid % 2 = 0"), events.filter("tid % 2 = 1")]
    one = Progressive(spark, zoom=3)
    two = Progressive(spark, zoom=3, store=f"{tmp_path}/store")
    one.update(halves[0], 0)
    two.update(halves[0], 0)
    two = Progressive(spark, zoom=3, store=f"{tmp_path}/store")
    assert two.last == 0
    for p in (one, two):
        p.update(halves[0], 0)
        p.update(halves[1], 1)
    assert [sorted((r.key, r.n) for r in p.state.collect()) for p in (two,)] == [sorted((r.key, r.n) for r in one.state.collect())]


def test_requests(spark, points):
    session = Session(points.select("tid", F.lit(None).cast("timestamp").alias("create_at"), F.lit("cat").alias("text"), "x", "y"), max_zoom=3)
    box = (-180.0, -80.0, 180.0, 80.0)
    asked = [{"id": "a", "type": "query", "query": {"keyword": "cat", "bbox": box, "zoom": 2, "algorithm": "DE"}}, {"id": "b", "type": "preset", "query": {"name": "cluster", "keyword": "cat", "bbox": box, "zoom": 2, "algorithm": "LBiSC"}},
             {"id": "c", "type": "query", "query": {"keyword": "cat", "bbox": box, "zoom": 2, "algorithm": "?"}}, {"id": "d", "type": "cmd", "cmd": "status"}, {"id": "e", "type": "cmd", "cmd": "clear"}, {"id": "f", "type": "x"}]
    got = [*session.requests(asked[:2])] + [*session.requests(asked[2:])]
    assert [r["ok"] for r in got] == [True, True, False, True, True, False] and got[0]["rows"] == points.count() and not session.built
    assert got[0]["answer"].count() == points.count() and got[1]["answer"].agg(F.sum("n")).first()[0] == points.count()  # after the clear
    held = len(session.dropped)
    del got
    gc.collect()
    assert held and session.swept() == 0
    east = session.query("cat", (100.0, -80.0, -100.0, 80.0), 2, "QTA", res_x=64, res_y=64)
    assert east.filter("x > 0.3 and x < 0.7").count() == 0


def test_evicted_tables_stay_for_their_answers(spark, points):
    events = points.select("tid", F.lit(None).cast("timestamp").alias("create_at"), F.when(F.col("tid") % 2 == 0, "cat").otherwise("dog").alias("text"), "x", "y")
    session, box = Session(events, max_zoom=3, most=2), (-180.0, -80.0, 180.0, 80.0)
    cats = session.query("cat", box, 2)
    files = [f for lease in session.built.values() for f in lease.table.inputFiles()]
    session.query("dog", box, 2)  # evicts both tables of cats
    assert "cat-original-points" not in session.built and len(session.built) == 2 and len(session.dropped) == 2
    assert cats.agg(F.sum("n")).first()[0] == events.filter("text = 'cat'").count()
    del cats
    gc.collect()
    assert session.swept() == 0 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


@pytest.mark.parametrize("hot", [20_000, 30])
def test_markers(points, rows, hot, monkeypatch):
    monkeypatch.setattr(clustering, "HOT", hot)
    leads, n = [], {}
    for k, x, y in rows:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in leads)
        if near and near[0][0] < 0.05:
            n[near[0][1]] += 1
        else:
            leads.append((k, x, y))
            n[k] = 1
    assert {r.leader: r.n for r in clustering.markers(points, 0.05).collect()} == n


def test_hulls(points, rows):
    got = clustering.hulls(points.withColumn("label", F.lit(1).cast("long")), parts=5).first()
    corners = [tuple(p) for p in got.hull]
    assert set(corners) <= {(x, y) for _, x, y in rows} and (got.left, got.top) == (min(p[1] for p in rows), min(p[2] for p in rows))
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for _, x, y in rows)


def test_slices_update_or_rebuild(spark, small):
    from cartograin.streaming.progressive import by_slices

    events = sources.from_events(spark, small).filter("text = 'click'")
    found = [[(p, sorted((r.key, r.n) for r in s.collect())) for p, s in by_slices(events, datetime(2024, 1, 1), datetime(2024, 1, 31), 10, 3, cumulative=c)] for c in (False, True)]
    assert found[0] == found[1] and [p for p, _ in found[0]] == [33, 66, 100]


def test_stems():
    from cartograin.functions.stemming import stem

    want = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing hopping hop falling fall filing file happy happi sky sky relational relat conditional condit digitizer digit radicalli radic vietnamization vietnam triplicate triplic electrical electr goodness good revival reviv adjustment adjust adoption adopt probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in want[::2]] == want[1::2]


def test_english_queries(spark):
    docs = spark.createDataFrame([(1, "The cats were running"), (2, "a runner"), (3, "the of")], "id long, text string")
    of = lambda q: sorted(r.id for r in docs.filter(match(F.col("text"), q, english=True)).collect())
    assert of("the | cat") == [1] and of("!the") == [] and of("cat & !the") == [1] and of("(the | of) & cat") == [1] and of("the & of") == []
    assert of("cat & runs") == [1] and of("the & runner") == [2]
    assert of("cat <-> running") == [] and of("cat <-> were <-> running") == of("cat <-> the <-> running") == of("the <-> cats") == [1] and of("cats <-> were <-> were <-> running") == []  # a stop word keeps its place


def test_marker_radius_and_pixels(spark):
    rows = [(7, None), (7, -1.0), (3, None), (30, None), (None, None), (7, 0.0), (7, m.radius(5) * 2)]
    df = spark.createDataFrame(rows, "level int, diameter double")
    got = [tuple(r[0]) for r in df.select(m.marker_radius(F.col("level"), F.col("diameter"), 5, shift=1)).collect()]
    want = [5, 5, 80, 10, 10, 1, 40]
    assert got == [pytest.approx((0.7 * w, 0.3 * w)) for w in want]
    at = spark.createDataFrame([(0.0, 0.0), (180.0, -90.0)], "lng double, lat double").select(m.pixel_x(F.col("lng"), 3), m.pixel_y(F.col("lat"), 3)).collect()
    assert [tuple(r) for r in at] == [(1024.0, 1024.0), (2048.0, 2048.0)]


def test_points_are_sent_by_slices(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [(1, day(1), "a b", 10.0, 20.0), (2, day(4), "a", 11.0, 21.0), (3, day(7), "a", 0.0, 0.0), (4, day(2), "b", 1.0, 1.0), (5, day(2), "a", None, 1.0), (6, None, "a", 1.0, 1.0), (7, day(3), None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "tid long, create_at timestamp, text string, x double, y double")
    got = sorted(tuple(r) for r in sources.transferred(df, day(1), day(7), 3, "a").collect())
    assert got == [(0, 50, 1, [20.0, 10.0, 1.0]), (1, 100, 2, [21.0, 11.0, 2.0])]
    assert sources.transferred(df.limit(0), day(1), day(7), 3).count() == 0
    feature = json.loads(sinks.point_features(df.filter("tid = 1")).first().feature)
    assert feature == {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [10.0, 20.0]}}


def test_raster_histograms(spark):
    rows = [(12, 0, 0, 1)] + [(11, 1, 1, 2500)] * 130 + [(11, 2, 2, 7)] * 3 + [(12, 3, 3, 4)] * 4 + [(5, 0, 0, 9)] * 2
    df = spark.createDataFrame(rows, "level int, i long, j long, n long")
    got = {tuple(r) for r in aggregation.raster_histograms(df, 12, 11).collect()}
    assert got == {("inner", 100, 1), ("inner", 3, 1), ("leaf", 1, 1), ("leaf", 4, 1), ("level", 100, 1), ("level", 3, 1), ("level_points", 100, 1), ("level_points", 0, 1)}


def test_replay(spark, points):
    at = Session(points.selectExpr("tid", "timestamp'2024-01-01' as create_at", "'click' as text", "x", "y"))
    move = {"keyword": None, "bbox": (-180, -90, 180, 90), "zoom": 3, "algorithm": "DataExplorer"}
    got = at.replayed([move, {"zoom": 4}]).orderBy("step", F.desc("phase")).collect()
    assert [(r.step, r.zoom, r.phase, r.rows, r.seconds is None) for r in got] == [(0, 3, "build points", -1, False), (0, 3, "answer", points.count(), False), (1, 4, "none", -1, True)]


def test_recorded_moves_are_replayed_by_phases(spark, points, tmp_path):
    session = Session(points.selectExpr("tid", "timestamp'2024-01-01' as create_at", "'click' as text", "x", "y"), max_zoom=4)
    moves = [{"keyword": None, "bbox": [-180, -90, 180, 90], "zoom": z, "tree_cut": True} for z in (1, 2)]
    (tmp_path / "moves.json").write_text("\n".join([json.dumps(moves[0]), "", json.dumps({"zoom": 4}), json.dumps(moves[1])]) + "\n")
    log = recorded(spark, str(tmp_path / "moves.json"))
    got = session.replayed(log).collect()
    phases = {}
    for r in got:
        phases.setdefault(r.step, []).append(r.phase)
    assert phases == {0: ["build points", "build exact", "plan cut", "answer"], 1: ["none"], 2: ["plan cut", "answer"]}
    session.replayed(log).toPandas().to_csv(tmp_path / "out.csv", index=False)
    assert (tmp_path / "out.csv").read_text().startswith("step,zoom,phase,rows,seconds")
    (tmp_path / "bad.json").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        session.replayed(recorded(spark, str(tmp_path / "bad.json")))
