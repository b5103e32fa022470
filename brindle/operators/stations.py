"""Weather stations and buoys: places and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boxes of states as least and most latitude, least and most longitude.
STATE_BOXES = {
    "AL": (30.22, 35.01, -88.47, -84.89), "AK": (51.21, 71.39, -179.15, -129.98), "AZ": (31.33, 37.00, -114.81, -109.04), "AR": (33.00, 36.50, -94.62, -89.64),
    "CA": (32.53, 42.01, -124.41, -114.13), "CO": (36.99, 41.00, -109.06, -102.04), "CT": (40.98, 42.05, -73.73, -71.79), "DE": (38.45, 39.84, -75.79, -75.05),
    "FL": (24.40, 31.00, -87.63, -80.03), "GA": (30.36, 35.00, -85.61, -80.84), "HI": (18.91, 22.24, -160.25, -154.81), "ID": (41.99, 49.00, -117.24, -111.04),
    "IL": (36.97, 42.51, -91.51, -87.02), "IN": (37.77, 41.76, -88.10, -84.78), "IA": (40.38, 43.50, -96.64, -90.14), "KS": (36.99, 40.00, -102.05, -94.59),
    "KY": (36.50, 39.15, -89.57, -81.96), "LA": (28.93, 33.02, -94.04, -88.82), "ME": (43.06, 47.46, -71.08, -66.95), "MD": (37.91, 39.72, -79.49, -75.05),
    "MA": (41.24, 42.89, -73.51, -69.93), "MI": (41.70, 48.26, -90.42, -82.41), "MN": (43.50, 49.38, -97.24, -89.49), "MS": (30.17, 34.99, -91.66, -88.10),
    "MO": (35.99, 40.61, -95.77, -89.10), "MT": (44.36, 49.00, -116.05, -104.04), "NE": (39.99, 43.00, -104.05, -95.31), "NV": (35.00, 42.00, -120.01, -114.04),
    "NH": (42.70, 45.31, -72.56, -70.70), "NJ": (38.93, 41.36, -75.56, -73.89), "NM": (31.33, 37.00, -109.05, -103.00), "NY": (40.50, 45.02, -79.76, -71.86),
    "NC": (33.84, 36.59, -84.32, -75.46), "ND": (45.94, 49.00, -104.05, -96.55), "OH": (38.40, 41.98, -84.82, -80.52), "OK": (33.62, 37.00, -103.00, -94.43),
    "OR": (41.99, 46.29, -124.57, -116.46), "PA": (39.72, 42.27, -80.52, -74.69), "RI": (41.15, 42.02, -71.86, -71.12), "SC": (32.05, 35.22, -83.35, -78.54),
    "SD": (42.48, 45.94, -104.06, -96.44), "TN": (34.98, 36.68, -90.31, -81.65), "TX": (25.84, 36.50, -106.65, -93.51), "UT": (36.99, 42.00, -114.05, -109.04),
    "VT": (42.73, 45.02, -73.44, -71.46), "VA": (36.54, 39.47, -83.68, -75.24), "WA": (45.54, 49.00, -124.85, -116.92), "WV": (37.20, 40.64, -82.64, -77.72),
    "WI": (42.49, 47.08, -92.89, -86.25), "WY": (40.99, 45.01, -111.06, -104.05),
}


def _inside(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["low_lat"], box["high_lat"]) & lon.between(box["low_lon"], box["high_lon"])


def _box(corners: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(corners, ("low_lat", "high_lat", "low_lon", "high_lon"), strict=True)])


def in_state(lat: Column, lon: Column, state: Column) -> Column:
    """Whether a place lies in the box of a state (two letters, any case);
    false for unknown states."""
    boxes = F.create_map(*[x for s, b in STATE_BOXES.items() for x in (F.lit(s), _box(b))])
    return F.coalesce(_inside(F.try_element_at(boxes, F.upper(F.coalesce(state, F.lit("")))), lat, lon), F.lit(False))


def states_of(lat: Column, lon: Column) -> Column:
    """All states whose box holds a place, as boxes overlap."""
    boxes = F.array(*[F.struct(F.lit(s).alias("state"), _box(b).alias("box")) for s, b in STATE_BOXES.items()])
    return F.transform(F.filter(boxes, lambda s: F.coalesce(_inside(s["box"], lat, lon), F.lit(False))), lambda s: s["state"])


def active_stations(stations: DataFrame, order: str, country: str = "US", state: str = "", most: int = 10) -> DataFrame:
    """The first ``most`` stations of a country, and state if one is given,
    that have a place; (0, 0) is none."""
    here = (F.col("country") == country) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    here = here & (F.col("state") == state) if state else here
    return stations.filter(here).orderBy(order).limit(most)


def buoys(stations: DataFrame, box: tuple | None = None, types: set[str] | None = None, sensors: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """Buoys in a box (both ends inclusive), of some types, with all the
    sensors named active, by id; at most ``most`` unless that is 0."""
    keep = F.lit(True)
    if box is not None:
        keep = keep & F.coalesce(_inside(_box(box), F.col("lat"), F.col("lon")), F.lit(False))
    if types is not None:
        keep = keep & F.coalesce("type", F.lit("")).isin(*types)
    for sensor in sensors:
        keep = keep & F.coalesce(F.col(sensor), F.lit(False))
    found = stations.filter(keep).orderBy("station_id")
    return found.limit(most) if most else found
