"""A session: hierarchies kept by key, the engines' names, presets and progressive answers."""

from __future__ import annotations

import json
import time
import weakref
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.mercator import boxes
from ..operators import aggregation, clustering, incremental, visible
from ..sources import points as sources
from .shared import numbered, removed, written

#: Names of engines by which a query may ask.
ENGINES = {
    **dict.fromkeys(("supercluster", "isupercluster", "isc", "sbisupercluster", "sbisc", "sbic"), "exact"),
    **dict.fromkeys(("lbisupercluster", "lbisc", "bisupercluster", "bisc"), "level-batch"),
    **dict.fromkeys(("aisupercluster", "aisc"), "approximate"),
    **dict.fromkeys(("dataexplorer", "de"), "raw"),
    **dict.fromkeys(("dataaggregator", "da"), "pixels"),
    **dict.fromkeys(("quadtreeaggregator", "qta"), "quadtree"),
    **dict.fromkeys(("gquadtreeaggregator", "gqta"), "raster"),
}
PRESETS = {"cluster": {"tree_cut": False}, "scatter": {"tree_cut": True, "measure": "max", "pixels": 1.0}, "heat": {"tree_cut": True, "measure": "max", "pixels": 2.0}}


class Lease:
    """A table that answers read: it goes when it is dropped and the last answer that reads it is gone."""

    def __init__(self, table: DataFrame):
        self.table, self.answers, self.dropped = table, 0, False

    def held_by(self, answer: DataFrame) -> None:
        self.answers += 1
        weakref.finalize(answer, self._released).atexit = False

    def _released(self) -> None:
        self.answers -= 1

    def over(self) -> bool:
        return self.dropped and not self.answers


@dataclass
class Session:
    """Answers queries over a table of points (tid, create_at, text, x, y); keeps what it built, and drops what is least used.

    An answer holds the tables it reads for as long as the answer itself is referred to (not only what was derived from it);
    eviction and clear() take them out of use at once, their files go with the last answer.
    """

    table: DataFrame
    max_zoom: int = 17
    most: int = 30
    built: dict[str, Lease] = field(default_factory=dict)
    hits: dict[str, int] = field(default_factory=dict)
    dropped: list[Lease] = field(default_factory=list)
    phases: dict[str, float] = field(default_factory=dict)

    def points(self, keyword: str | None, order: str = "original") -> DataFrame:
        return sources.ordered(sources.projected(sources.scan(self.table, keyword)), order)

    def _drop(self, key: str) -> None:
        lease = self.built.pop(key)
        lease.dropped = True
        self.dropped.append(lease)
        del self.hits[key]

    def swept(self) -> int:
        """Deletes dropped tables that no answer reads any more; how many dropped ones are left."""
        for lease in [x for x in self.dropped if x.over()]:
            removed(lease.table)
            self.dropped.remove(lease)
        return len(self.dropped)

    def clear(self) -> None:
        """Drops all that was built."""
        for key in [*self.built]:
            self._drop(key)
        self.swept()

    def _kept(self, key: str, make, used: list[Lease]) -> DataFrame:
        if key not in self.built:
            if len(self.built) >= self.most:
                self._drop(min(self.built, key=lambda k: self.hits[k]))
            began = time.perf_counter()
            self.built[key], self.hits[key] = Lease(make()), 0
            self.phases[f"build {key.rsplit('-', 1)[-1]}"] = time.perf_counter() - began
        self.hits[key] += 1
        used.append(self.built[key])
        return self.built[key].table

    def query(self, keyword: str | None, bbox, zoom: int, algorithm: str = "SuperCluster", order: str = "original", tree_cut: bool = False, measure: str = "max", pixels: float = 1.0, bipartite: bool = False, res_x: int = 1920, res_y: int = 978) -> DataFrame:
        """What the viewport shows, by the named engine."""
        engine = ENGINES.get(algorithm.lower())
        if engine is None:
            raise ValueError(f"unknown algorithm {algorithm!r}")
        self.swept()
        self.phases.clear()
        used: list[Lease] = []
        answer = self._shown(engine, f"{keyword}-{order}", lambda: self.points(keyword, order), used, bbox, zoom, tree_cut, measure, pixels, bipartite, res_x, res_y)
        for lease in used:
            lease.held_by(answer)
        return answer

    def _shown(self, engine, key, scan, used, bbox, zoom, tree_cut, measure, pixels, bipartite, res_x, res_y) -> DataFrame:
        points = self._kept(f"{key}-points", lambda: written(scan(), "session-points"), used)
        if engine == "raw":
            return aggregation.raw(points, bbox)
        if engine == "pixels":
            return aggregation.pixels(points, bbox, res_x, res_y)
        if engine == "quadtree":
            parts = boxes(bbox)
            side = min(sum(p[2] - p[0] for p in parts) / res_x, (parts[0][3] - parts[0][1]) / res_y)
            terminal = min(30, aggregation.terminal_level(side / 2 ** max(self.max_zoom - 4, 0)))
            return reduce(DataFrame.unionByName, (aggregation.quadtree(points, p, terminal, min(30, aggregation.cut_level(side))) for p in parts)).distinct()
        if engine == "raster":
            samples = self._kept(f"{key}-raster", lambda: written(aggregation.raster_samples(points, self.max_zoom + 1), "session-raster"), used)
            level = min(self.max_zoom + 1, aggregation.cut_level(pixels / 256 / 2**zoom if tree_cut else 1 / 256 / 2**zoom))
            return reduce(DataFrame.unionByName, (aggregation.raster_range(samples, p, level) for p in boxes(bbox))).distinct()
        builders = {"exact": clustering.hierarchy, "approximate": lambda p, z: _with_centroids(clustering.approximate(None, p, z)), "level-batch": lambda p, z: _with_centroids(incremental.level_batch(None, p, z))}
        tree = self._kept(f"{key}-{engine}", lambda: builders[engine](points, self.max_zoom), used)
        if tree_cut:
            began = time.perf_counter()
            answer = visible.cut(tree, bbox, zoom, pixels, measure, bipartite, self.max_zoom, engine == "exact")
            self.phases["plan cut"] = time.perf_counter() - began
            return answer
        return visible.visible(tree, bbox, zoom, by_leader=engine != "exact", high=self.max_zoom)

    def preset(self, name: str, keyword: str | None, bbox, zoom: int, **options) -> DataFrame:
        """A query with the options of a preset (cluster, scatter or heat); own options come first."""
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}")
        return self.query(keyword, bbox, zoom, **(PRESETS[name] | options))

    def requests(self, commands: Iterable[dict]):
        """Answers a batch of requests in order: yields {id, type, ok, rows, seconds, answer or message}.

        A request has id, type ("query", "preset" or "cmd") and the arguments of its method under "query"; cmd knows
        "clear" (drop all that was built) and "status" (what is built, with hits). A bad request gives ok = False.
        """
        for c in commands:
            began, out = time.perf_counter(), {"id": c.get("id"), "type": c.get("type")}
            try:
                if c.get("type") in ("query", "preset"):
                    answer = getattr(self, c["type"])(**c["query"])
                    out |= {"ok": True, "rows": answer.count(), "answer": answer}
                elif c.get("type") == "cmd" and c.get("cmd") in ("clear", "status"):
                    out |= {"ok": True, "rows": len(self.built), "answer": dict(self.hits)}
                    if c["cmd"] == "clear":
                        self.clear()
                else:
                    raise ValueError(f"unknown request {c!r}")
            except (ValueError, TypeError, KeyError) as e:
                out |= {"ok": False, "rows": 0, "message": str(e)}
            yield out | {"seconds": time.perf_counter() - began}

    def replayed(self, actions: Iterable[dict] | DataFrame) -> DataFrame:
        """(step, zoom, phase, rows, seconds): recorded moves of a map, asked in turn; a row for each phase of each step.

        actions: the arguments of queries, or a table of recorded() moves, which is short. Phases are the tables that the
        step had to build, "plan cut", and "answer", which counts the rows while it makes them, without a further action; a
        step without a box asks for nothing and has the one phase "none". A bad request raises.
        """
        if isinstance(actions, DataFrame):
            actions = [json.loads(r["query"]) for r in actions.orderBy("step").select("query").toLocalIterator()]
        out = []
        for step, action in enumerate(actions):
            if not action.get("bbox"):
                out.append((step, action.get("zoom"), "none", -1, None))
                continue
            answer, seen, began = self.query(**action), Observation(), time.perf_counter()
            planned = [(name, -1, seconds) for name, seconds in self.phases.items()]
            answer.observe(seen, F.count("*").alias("rows")).write.format("noop").mode("overwrite").save()
            planned.append(("answer", seen.get["rows"], time.perf_counter() - began))
            out += [(step, action["zoom"], *phase) for phase in planned]
        return self.table.sparkSession.createDataFrame(out, "step int, zoom int, phase string, rows long, seconds double")


def recorded(spark, path: str) -> DataFrame:
    """(step, query): the moves of a recording, JSON lines of queries' arguments; lines that are no JSON objects raise when read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.monotonically_increasing_id().alias("at"))
    moves = numbered(parsed, F.asc("at"), name="step")
    good = F.get_json_object("value", "$").startswith("{")
    return moves.select("step", F.when(good, F.col("value")).otherwise(F.raise_error(F.lit("not a JSON object"))).alias("query"))


def _with_centroids(state: DataFrame) -> DataFrame:
    return state.withColumns({"mx": F.col("sx") / F.col("n"), "my": F.col("sy") / F.col("n")})
