"""Spherical and planar geometry on columns.

Points are (lon, lat) in degrees; lines and rings are arrays of
``struct<lon:double, lat:double>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def line_length(points: Column) -> Column:
    """Metres along an array of points; fewer than two points have length 0."""
    nexts = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    starts = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(starts, nexts, lambda p, q: haversine(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def ring_area(points: Column) -> Column:
    """Square metres of a ring, planar at the ring's middle latitude."""
    lats = F.transform(points, lambda p: p["lat"])
    mid = (F.array_max(lats) + F.array_min(lats)) / 2
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    shoelace = F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2
    return shoelace * METRES_PER_DEGREE * METRES_PER_DEGREE * F.cos(F.radians(mid))


def equivalent_radius(area: Column) -> Column:
    """Radius of the circle of that area."""
    return F.sqrt(area / math.pi)


def centroid(points: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda name: F.aggregate(F.transform(points, lambda p: p[name]), F.lit(0.0), lambda s, x: s + x) / F.size(points)
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def bounds(points: Column) -> Column:
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Inclusive bounds; a null coordinate is outside."""
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def contains(points: Column, lon: Column, lat: Column) -> Column:
    """Whether a ring holds a point: an odd number of edges cross its ray."""
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(
        points,
        after,
        lambda p, q: F.when((p["lat"] > lat) != (q["lat"] > lat), lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]).otherwise(False),
    )
    return F.size(F.filter(crossed, lambda x: x)) % 2 == 1


def cell(lon: Column, lat: Column, degrees: float) -> Column:
    return F.struct(F.floor(lon / degrees).cast("long").alias("x"), F.floor(lat / degrees).cast("long").alias("y"))


def thin(points: Column, most: int = 80) -> Column:
    """Every k-th vertex so that about ``most`` stay, the last one always."""
    step = F.greatest(F.floor(F.size(points) / most), F.lit(1))
    kept = F.filter(points, lambda p, i: i % step == 0)
    return F.when((F.size(points) - 1) % step == 0, kept).otherwise(F.concat(kept, F.slice(points, -1, 1)))


def climb(elevations: Column) -> Column:
    """Struct (gain, loss) of the consecutive differences of an array."""
    n = F.greatest(F.size(elevations) - 1, F.lit(0))
    steps = F.zip_with(F.slice(elevations, F.lit(1), n), F.slice(elevations, F.lit(2), n), lambda a, b: b - a)
    add = lambda keep: F.aggregate(F.transform(steps, keep), F.lit(0.0), lambda s, x: s + x)
    return F.struct(add(lambda d: F.greatest(d, F.lit(0.0))).alias("gain"), add(lambda d: F.greatest(-d, F.lit(0.0))).alias("loss"))


def zoom_for(span: Column) -> Column:
    """Map zoom by the larger span in degrees."""
    # Span in degrees from which each zoom level is used.
    ladder = [(10.0, 5), (5.0, 6), (2.0, 8), (1.0, 9), (0.5, 10), (0.1, 12)]
    out = F.when(span > ladder[0][0], ladder[0][1])
    for least, zoom in ladder[1:]:
        out = out.when(span > least, zoom)
    return out.otherwise(14)


def drive_estimate(metres: Column, detour: float = 1.3, kmh: float = 80.0) -> Column:
    """Struct (km, minutes) of a drive guessed from the straight distance."""
    km = metres / 1000 * detour
    return F.struct(km.alias("km"), (km / kmh * 60).alias("minutes"))
