"""Web-Mercator columns and scalars: longitude and latitude to the unit square (y grows southward) and back, boxes, radii."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cluster radius in pixels, tile extent, and the zoom range of the defaults.
RADIUS, EXTENT, MIN_ZOOM, MAX_ZOOM = 20.0, 128.0, 0, 17


def lng_x(lng: Column) -> Column:
    return lng / 360.0 + 0.5


def lat_y(lat: Column) -> Column:
    """0 from 90 degrees north and beyond, 1 from 90 south; clamped between."""
    s = F.sin(F.radians(lat))
    inner = 0.5 - 0.25 * F.log((1.0 + s) / F.when((lat < 90) & (lat > -90), 1.0 - s)) / math.pi
    return F.when(lat >= 90, 0.0).when(lat <= -90, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))


def x_lng(x: Column) -> Column:
    return (x - 0.5) * 360.0


def y_lat(y: Column) -> Column:
    return 360.0 * F.atan(F.exp((180.0 - y * 360.0) * math.pi / 180.0)) / math.pi - 90.0


def x_of(lng: float) -> float:
    return lng / 360.0 + 0.5


def y_of(lat: float) -> float:
    if abs(lat) >= 90:
        return 0.0 if lat > 0 else 1.0
    s = math.sin(math.radians(lat))
    return min(1.0, max(0.0, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi))


def radius(zoom: int) -> float:
    """The cluster radius at a zoom, in units of the square."""
    return RADIUS / (EXTENT * 2.0**zoom)


def pixel_distance(zoom: int, pixels: float) -> float:
    return radius(zoom) / RADIUS * pixels


def limit_zoom(zoom: int, low: int = MIN_ZOOM, high: int = MAX_ZOOM) -> int:
    return max(low, min(high, int(zoom)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def boxes(bbox) -> list[tuple[float, float, float, float]]:
    """(left, top, right, bottom) in the unit square of a box in degrees (west, south, east, north).

    Longitudes wrap (180 stays 180), a box of 360 degrees or more is the whole world, latitudes are clamped, and a box
    across the antimeridian gives two.
    """
    west, south, east, north = map(float, bbox)
    wrap = lambda v: ((v + 180.0) % 360.0 + 360.0) % 360.0 - 180.0
    south, north = max(-90.0, min(90.0, south)), max(-90.0, min(90.0, north))
    left, right = wrap(west), 180.0 if east == 180.0 else wrap(east)
    if east - west >= 360.0:
        left, right = -180.0, 180.0
    spans = [(left, right)] if left <= right else [(left, 180.0), (-180.0, right)]
    return [(x_of(a), y_of(north), x_of(b), y_of(south)) for a, b in spans]


def within(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Strictly inside: points on an edge are outside."""
    left, top, right, bottom = box
    return (x > left) & (x < right) & (y > top) & (y < bottom)


def within_any(x: Column, y: Column, bbox) -> Column:
    """Strictly inside a box in degrees, wherever it lies."""
    found = [within(x, y, b) for b in boxes(bbox)]
    return found[0] if len(found) == 1 else found[0] | found[1]


def node_id(index: Column, zoom: int) -> Column:
    return F.shiftleft(index.cast("long"), 5) + F.lit(zoom + 1).cast("long")


def icon_size(n: Column) -> Column:
    return F.when(n < 100, "small").when(n < 1000, "medium").otherwise("large")


def colour(n: Column, most: Column) -> Column:
    """An HSL colour by the logarithm of a count."""
    v = F.when(most > 1, F.log(n) / F.log(most)).otherwise(F.lit(0.0))
    return F.format_string("hsl(%.0f,%.0f%%,50%%)", 100.0 - 100.0 * v, 60.0 + 30.0 * v)


#: A tile's side in pixels, a marker's radius, its least one, its shares of fill and edge, and the level from which records are raw points.
TILE, MARKER, LEAST_MARKER, FILL, EDGE, RAW_LEVEL = 256.0, 20.0, 1.0, 0.7, 0.3, 25


def pixel_x(lng: Column, zoom: int) -> Column:
    """Pixels from the world's western edge at a zoom."""
    return lng_x(lng) * (TILE * 2.0**zoom)


def pixel_y(lat: Column, zoom: int) -> Column:
    """Pixels from the world's northern edge at a zoom."""
    return lat_y(lat) * (TILE * 2.0**zoom)


def marker_radius(level: Column, diameter: Column, zoom: int, base: float = MARKER, shift: int = 0) -> Column:
    """(fill, edge) in pixels of the marker of a cluster of a level, on a map at a zoom.

    A known diameter (0 or more, in the unit square) is measured by the cluster radius of the zoom; else the marker halves with
    each level below the zoom (raw points: with each of shift). A null level counts as raw points.
    """
    below = F.when(level < RAW_LEVEL, level - zoom).otherwise(shift)
    scaled = F.when(diameter >= 0, diameter * base / radius(zoom)).otherwise(base / F.pow(F.lit(2.0), below.cast("double")))
    whole = F.greatest(scaled, F.lit(LEAST_MARKER))
    return F.struct((whole * FILL).alias("fill"), (whole * EDGE).alias("edge"))
