"""DuckDB SQL of the whole tree of clusters, level by level, for the queries that are read from it.

A level's leaders are found in rounds over the pairs of nodes within the radius: a node with an earlier leader is covered,
one without an earlier undecided node leads.
"""

from __future__ import annotations

from ..functions import mercator as m


def _level(z: int) -> str:
    r, up = f"{m.radius(z)!r}::DOUBLE", f"n{z + 1}"
    return f"""
c{z} AS MATERIALIZED (SELECT key, mx, my, floor(mx/{r})::BIGINT AS ci, floor(my/{r})::BIGINT AS cj FROM {up}),
p{z} AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM (SELECT key, mx, my, ci+i AS ci, cj+j AS cj FROM c{z}, range(-1, 2) AS t(i), range(-1, 2) AS u(j)) a JOIN c{z} b ON a.ci = b.ci AND a.cj = b.cj AND a.key < b.key WHERE sqrt(pow(a.mx-b.mx, 2)+pow(a.my-b.my, 2)) <= {r}),
s{z}(step, key, state, undecided) AS (SELECT 0, key, 0, 1 FROM {up} UNION ALL
  SELECT step, key, state, (count(*) FILTER (state = 0) OVER ())::INT FROM (SELECT s.step + 1 AS step, s.key, CASE WHEN s.state > 0 THEN s.state WHEN coalesce(bool_or(o.state = 1), false) THEN 2 WHEN coalesce(bool_or(o.state = 0), false) THEN 0 ELSE 1 END AS state
  FROM s{z} s LEFT JOIN p{z} p ON p.b = s.key LEFT JOIN s{z} o ON o.key = p.a WHERE s.undecided > 0 GROUP BY s.step, s.key, s.state)),
f{z} AS MATERIALIZED (SELECT key, state FROM s{z} WHERE step = (SELECT max(step) FROM s{z})),
m{z} AS MATERIALIZED (SELECT f.key, CASE WHEN f.state = 1 THEN f.key ELSE min(g.key) END AS leader FROM f{z} f LEFT JOIN p{z} p ON p.b = f.key LEFT JOIN f{z} g ON g.key = p.a AND g.state = 1 GROUP BY f.key, f.state),
n{z} AS MATERIALIZED (SELECT leader AS key, sum(sx)/sum(n) AS mx, sum(sy)/sum(n) AS my, sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sy) AS sy, count(*) AS children, CASE WHEN count(*) = 1 THEN min(expansion_zoom) ELSE {z + 1} END AS expansion_zoom FROM {up} JOIN m{z} USING (key) GROUP BY leader)"""


def _raw(top: int) -> str:
    return f"n{top + 1} AS MATERIALIZED (SELECT min(seq) AS key, mx, my, count(*) AS n, mx*count(*) AS sx, my*count(*) AS sy, 1 AS children, {top + 1} AS expansion_zoom FROM q GROUP BY mx, my)"


def _levels(top: int, bottom: int) -> str:
    return f"{_raw(top)}, {', '.join(_level(z) for z in range(top, bottom - 1, -1))}"


def tree(points: str, top: int = m.MAX_ZOOM, bottom: int = m.MIN_ZOOM) -> str:
    """WITH clause (points: its first entries, with q) that ends with t (level, key, parent, mx, my, n, children, expansion_zoom)."""
    parent = lambda z: f"LEFT JOIN m{z - 1} m ON m.key = n.key" if z > bottom else "LEFT JOIN (SELECT NULL::BIGINT AS key, NULL::BIGINT AS leader) m ON m.key = n.key"
    levels = " UNION ALL ".join(f"SELECT {z}::INTEGER AS level, n.key, m.leader AS parent, n.mx, n.my, n.n, n.children, n.expansion_zoom::INTEGER AS expansion_zoom FROM n{z} n {parent(z)}" for z in range(top, bottom - 1, -1))
    return f"WITH RECURSIVE {points}, {_levels(top, bottom)}, t AS MATERIALIZED ({levels})"


def _chain(zoom: int, top: int) -> str:
    """Rows of q with the leaders of their clusters at zoom and above, as a{z}.leader."""
    joins = " ".join(f"JOIN m{z} a{z} ON a{z}.key = {f'a{z + 1}.leader' if z < top else 'r.key'}" for z in range(top, zoom - 1, -1))
    return f"q JOIN n{top + 1} r ON r.mx = q.mx AND r.my = q.my {joins}"


def labels(points: str, zoom: int, top: int = m.MAX_ZOOM) -> str:
    """(tid, label): each point's cluster at a zoom, from level to level."""
    return f"{tree(points, top, zoom)} SELECT q.tid, a{zoom}.leader AS label FROM {_chain(zoom, top)}"


def order_agreement(points: str, orders: dict[str, str], zooms: range, top: int = m.MAX_ZOOM) -> str:
    """(order, zoom, rand, adjusted_rand) of the clustering in each order with that in the first."""
    base = "(SELECT *, row_number() OVER (ORDER BY {}) - 1 AS seq FROM (SELECT * EXCLUDE (seq) FROM q))"
    parts = []
    for name, order in orders.items():
        picked = ", ".join(f"a{z}.leader AS l{z}" for z in zooms)
        parts.append(f"o{len(parts)} AS MATERIALIZED (WITH RECURSIVE q AS MATERIALIZED {base.format(order).replace('FROM q', 'FROM points')}, {_levels(top, min(zooms))} SELECT '{name}' AS name, q.tid, {picked} FROM {_chain(min(zooms), top)})")
    rows = " UNION ALL ".join(f"SELECT b.name, {z} AS zoom, a.l{z} AS a, b.l{z} AS b FROM o0 a JOIN o{k} b ON b.tid = a.tid" for k in range(len(parts)) for z in zooms)
    two = "sum(n*(n-1)/2)"
    return f"""WITH {points}, points AS (SELECT * FROM q), {', '.join(parts)}, l AS ({rows}), n AS (SELECT name, zoom, a, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
x AS (SELECT name, zoom, {two} AS s FROM n GROUP BY ALL), y AS (SELECT name, zoom, {two} AS s FROM (SELECT name, zoom, a, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL),
w AS (SELECT name, zoom, {two} AS s FROM (SELECT name, zoom, b, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL), c AS (SELECT name, zoom, sum(n)*(sum(n)-1)/2 AS s FROM n GROUP BY ALL)
SELECT name AS "order", zoom::INTEGER AS zoom, round((c.s+2*x.s-y.s-w.s)/c.s, 8) AS rand, round((x.s-y.s*w.s/c.s)/((y.s+w.s)/2-y.s*w.s/c.s), 8) AS adjusted_rand FROM x JOIN y USING (name, zoom) JOIN w USING (name, zoom) JOIN c USING (name, zoom)"""


def scaling(points: str, least: int, doublings: int, top: int = m.MAX_ZOOM, bottom: int = m.MIN_ZOOM) -> str:
    """(level, clusters, n) of the first n points, n doubling from least up to the number of points (least at any rate)."""
    parts, sizes = [], [least * 2**k for k in range(doublings)]
    for n in sizes:
        counts = " UNION ALL ".join(f"SELECT {z}::INTEGER AS level, count(*) AS clusters FROM n{z}" for z in range(top, bottom - 1, -1))
        enough = "true" if n == least else f"(SELECT count(*) FROM points) >= {n}"
        parts.append(f"o{n} AS MATERIALIZED (WITH RECURSIVE q AS MATERIALIZED (SELECT * FROM points WHERE seq < {n} AND {enough}), {_levels(top, bottom)} {counts})")
    return f"WITH {points}, points AS (SELECT * FROM q), {', '.join(parts)} {' UNION ALL '.join(f'SELECT level, clusters, {n}::INTEGER AS n FROM o{n} WHERE clusters > 0' for n in sizes)}"


def tree_cut(points: str, box: str, zoom: int, d: float, measure: str) -> str:
    """(level, key, n) of what is shown of the clusters in a box at a zoom, each opened while its children lie d apart by min, max or avg."""
    return f"""{tree(points)},
d AS (SELECT a.level - 1 AS level, a.parent AS key, {measure}(sqrt(pow(a.mx-b.mx, 2)+pow(a.my-b.my, 2))) AS apart FROM t a JOIN t b ON a.level = b.level AND a.parent = b.parent AND a.key < b.key GROUP BY ALL),
e AS MATERIALIZED (SELECT t.*, t.level < {m.MAX_ZOOM} AND (children = 1 OR coalesce(apart >= {d!r}::DOUBLE, false)) AS expands FROM t LEFT JOIN d ON d.level = t.level AND d.key = t.key),
v AS (SELECT level, key, n, expands FROM e WHERE level = {zoom} AND {box} UNION ALL SELECT e.level, e.key, e.n, e.expands FROM v JOIN e ON e.level = v.level + 1 AND e.parent = v.key WHERE v.expands)
SELECT level, key, n FROM v WHERE NOT expands"""
