"""Results as GeoJSON, arrays and compact binary frames."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The frame's header (progress, three times) and its records (latitude, longitude, points), big-endian.
HEADER = ">iddd"
RECORD = np.dtype([("lat", ">f8"), ("lng", ">f8"), ("n", ">i4")])


def geojson(clusters: DataFrame) -> DataFrame:
    """(key, feature): a GeoJSON feature for each cluster (key, level, n, lng, lat[, expansion_zoom, diameter])."""
    of = lambda c, kind: F.col(c) if c in clusters.columns else F.lit(None).cast(kind)
    properties = F.struct(
        F.col("n").alias("point_count"), F.col("n").cast("string").alias("point_count_abbreviated"), F.col("key").alias("id"), of("expansion_zoom", "int").alias("expansionZoom"), of("level", "int").alias("zoom"), of("diameter", "double").alias("diameter")
    )
    geometry = F.struct(F.array("lng", "lat").alias("coordinates"), F.lit("Point").alias("type"))
    return clusters.select("key", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def arrays(clusters: DataFrame) -> DataFrame:
    """(key, row): [lat, lng, points] of each cluster."""
    return clusters.select("key", F.array(F.col("lat"), F.col("lng"), F.col("n").cast("double")).alias("row"))


def point_features(points: DataFrame) -> DataFrame:
    """(tid, feature): a GeoJSON feature for each raw point (tid, x, y), the lines of a feature collection."""
    geometry = F.struct(F.array("x", "y").alias("coordinates"), F.lit("Point").alias("type"))
    return points.select("tid", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("tid").alias("id")).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def records(clusters: DataFrame) -> DataFrame:
    """(n_records, bytes): packed records, a chunk for each batch of each partition; a frame is a header and all chunks."""

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                out = np.empty(len(pdf), RECORD)
                out["lat"], out["lng"], out["n"] = pdf["lat"], pdf["lng"], pdf["n"]
                yield pd.DataFrame({"n_records": [len(pdf)], "bytes": [out.tobytes()]})

    return clusters.select("lat", "lng", "n").mapInPandas(pack, "n_records long, bytes binary")


def frame(clusters: DataFrame, progress: int = 100, total: float = 0.0, cut: float = 0.0, aggregate: float = 0.0) -> bytes:
    """The binary answer for one screen: header and records. What a screen shows is small; it goes to the caller."""
    return struct.pack(HEADER, progress, total, cut, aggregate) + b"".join(bytes(r["bytes"]) for r in records(clusters).toLocalIterator())


def unframe(data: bytes) -> tuple[tuple, np.ndarray]:
    """Header and records of a frame."""
    at = struct.calcsize(HEADER)
    return struct.unpack_from(HEADER, data), np.frombuffer(data[at:], RECORD)
