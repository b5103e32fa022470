"""Map features: filters, classes, statistics, transit and road scores.

Features have ``tags`` (map<string, string>) and plain columns; missing tags are
null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import exact_mean, exact_sum, ratio
from brindle.operators.lineage import cut


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


# ---- filters --------------------------------------------------------------

# Names of comparison operators and their aliases.
ALIASES = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "==": "eq", "!=": "ne", "<>": "ne"}


def compare(value: Column, op: str, target: float, upper: float | None = None, tolerance: float = 0.0) -> Column:
    """gt, gte, lt, lte, eq, ne or between (inclusive); equality within a
    relative tolerance. A null value matches nothing."""
    op = ALIASES.get(op, op)
    near = F.abs(value - target) <= abs(target) * tolerance
    tests = {"gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target, "eq": near, "ne": ~near}
    test = value.between(target, upper) if op == "between" else tests[op]
    return F.coalesce(test, F.lit(False))


def tag_matches(wanted: dict[str, str]) -> Column:
    """All tags as wanted; ``*`` takes any value."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (tag(name).isNotNull() if value == "*" else tag(name).eqNullSafe(value))
    return out


def interests(rules: dict[str, dict[str, list[str] | None]]) -> Column:
    """Array of the categories a feature belongs to, from one scan: a rule
    holds if one of its keys is present (None) or has one of the values."""
    hits = []
    for category, keys in rules.items():
        any_key = F.lit(False)
        for key, values in keys.items():
            any_key = any_key | (tag(key).isNotNull() if values is None else F.coalesce(tag(key).isin(*values), F.lit(False)))
        hits.append(F.when(any_key, F.lit(category)))
    return F.array_compact(F.array(*hits))


def place_matches(place: str, admin_level: str) -> Column:
    """The place tag, or a boundary of the admin level."""
    return F.coalesce(tag("place") == place, F.lit(False)) | F.coalesce((tag("boundary") == "administrative") & (tag("admin_level") == admin_level), F.lit(False))


def name_search(pattern: str, column: str = "name") -> Column:
    """A regular expression anywhere in the name, ignoring case."""
    return F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))


def park_class() -> Column:
    """National, state, nature_reserve, protected_area or park, by the first
    match of a ladder whose order matters; what matches nothing is protected_area."""
    protect, designation = tag("protect_class"), F.lower(F.coalesce(tag("designation"), F.lit("")))
    named = lambda *kinds: F.greatest(F.lit(False), *[F.contains(designation, F.lit(k + joint + last)) for k, last in kinds for joint in ("_", " ")])
    return (
        F.when((tag("boundary") == "national_park") | (protect == "2") | named(("national", "park")), "national")
        .when((protect == "5") | named(("state", "park"), ("regional", "park"), ("provincial", "park")), "state")
        .when((tag("leisure") == "nature_reserve") | protect.isin("1a", "1b") | named(("nature", "reserve")), "nature_reserve")
        .when(tag("boundary") == "protected_area", "protected_area")
        .when(tag("leisure") == "park", "park")
        .otherwise("protected_area")
    )


# Classes by the tags highway, amenity and building.
ROAD_CLASSES = {
    "motorway": ["motorway", "motorway_link"],
    "trunk": ["trunk", "trunk_link"],
    "primary": ["primary", "primary_link"],
    "secondary": ["secondary", "secondary_link"],
    "tertiary": ["tertiary", "tertiary_link"],
    "residential": ["residential", "living_street"],
    "service": ["service"],
    "unclassified": ["unclassified"],
    "track": ["track"],
    "path": ["path", "footway", "cycleway", "bridleway"],
}
AMENITY_CLASSES = {
    "food": ["restaurant", "cafe", "bar", "pub", "fast_food", "food_court", "ice_cream", "biergarten"],
    "services": ["bank", "atm", "post_office", "fuel", "car_wash", "car_rental", "charging_station", "parking"],
    "healthcare": ["hospital", "clinic", "doctors", "dentist", "pharmacy", "veterinary"],
    "education": ["school", "university", "college", "library", "kindergarten"],
    "entertainment": ["cinema", "theatre", "nightclub", "casino", "arts_centre"],
    "transport": ["bus_station", "ferry_terminal", "taxi"],
}
BUILDING_CLASSES = {
    "residential": ["house", "residential", "apartments", "detached", "semidetached_house", "terrace", "dormitory"],
    "commercial": ["commercial", "hotel"],
    "office": ["office"],
    "industrial": ["industrial", "warehouse", "factory", "manufacture"],
    "retail": ["retail", "supermarket", "kiosk"],
    "public": ["public", "civic", "government", "hospital", "school", "university", "kindergarten"],
    "religious": ["church", "chapel", "cathedral", "mosque", "temple", "synagogue"],
}
TOURISM_SERVICES = ["hotel", "motel", "hostel", "guest_house"]
TOURISM_ENTERTAINMENT = ["museum", "gallery", "zoo", "theme_park"]
PUBLIC_AMENITIES = ["hospital", "school", "university", "library", "townhall"]


def _class_of(value: Column, classes: dict[str, list[str]]) -> Column:
    found = F.create_map(*[F.lit(x) for name, values in classes.items() for v in values for x in (v, name)])
    return F.try_element_at(found, F.coalesce(value, F.lit("")))


def road_class() -> Column:
    return F.coalesce(_class_of(tag("highway"), ROAD_CLASSES), F.lit("other"))


def amenity_class() -> Column:
    """By the amenity tag, else any shop, else tourism."""
    other = F.when(tag("shop").isNotNull(), "shopping").when(tag("tourism").isin(*TOURISM_SERVICES), "services").when(tag("tourism").isin(*TOURISM_ENTERTAINMENT), "entertainment").otherwise("other")
    return F.coalesce(_class_of(tag("amenity"), AMENITY_CLASSES), other)


def building_class() -> Column:
    """By the building tag, else public amenities, else any shop, else any office."""
    other = F.when(tag("amenity").isin(*PUBLIC_AMENITIES), "public").when(tag("shop").isNotNull(), "retail").when(tag("office").isNotNull(), "office").otherwise("other")
    return F.coalesce(_class_of(tag("building"), BUILDING_CLASSES), other)


# Tag values that a feature load takes in, by category and kind.
LOAD_VALUES = {
    "routes": {
        "bicycle": ["bicycle", "mtb"],
        "hiking": ["hiking", "foot", "walking"],
        "train": ["train", "railway", "light_rail", "subway", "tram"],
        "bus": ["bus", "trolleybus"],
    },
    "amenities": {
        "food": ["restaurant", "cafe", "bar", "fast_food", "pub", "food_court", "ice_cream"],
        "shopping": ["supermarket", "mall", "convenience", "department_store", "clothes", "shoes"],
        "services": ["bank", "atm", "post_office", "fuel", "charging_station", "parking"],
        "healthcare": ["hospital", "pharmacy", "doctors", "clinic", "dentist", "veterinary"],
        "education": ["school", "university", "library", "college", "kindergarten"],
        "entertainment": ["cinema", "theatre", "nightclub", "arts_centre", "casino"],
        "transport": ["bus_station", "taxi", "ferry_terminal", "bicycle_parking", "bicycle_rental"],
    },
    "roads": {
        "motorway": ["motorway", "motorway_link"],
        "primary": ["primary", "primary_link"],
        "secondary": ["secondary", "secondary_link"],
        "tertiary": ["tertiary", "tertiary_link"],
        "residential": ["residential", "living_street"],
        "major": ["motorway", "motorway_link", "primary", "primary_link", "secondary", "secondary_link"],
    },
}
LOAD_KEYS = {"routes": ["route", "route_type"], "amenities": ["amenity"], "roads": ["highway"], "buildings": ["building"]}
LOADS = ["routes", "amenities", "roads", "parks", "buildings", "boundaries", "population", "pois"]


def load_matches(category: str, kind: str = "all", least_population: int = 0) -> Column:
    """Whether a feature load of a category takes a feature in. A kind without
    a list of values is its own value; boundaries and points of interest take
    everything, as the kind ``all`` does; a population that is no whole number is 0."""
    if category == "population":
        people = F.coalesce(F.trim(tag("population")).try_cast("long"), F.lit(0))
        return (people >= least_population) & (F.coalesce(tag("place") == kind, F.lit(False)) if kind != "all" else F.lit(True))
    if category in ("boundaries", "pois") or kind == "all":
        return F.lit(True)
    if category == "parks":
        ladder = {
            "national": (tag("boundary") == "national_park") | (tag("protect_class") == "2"),
            "state": tag("protect_class") == "5",
            "nature_reserve": tag("leisure") == "nature_reserve",
        }
        return F.coalesce(ladder.get(kind, F.lit(True)), F.lit(False))
    values = LOAD_VALUES.get(category, {}).get(kind, [kind])
    return F.greatest(F.lit(False), *[F.coalesce(tag(k).isin(*values), F.lit(False)) for k in LOAD_KEYS[category]])


def loads(features: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """One row per feature and wanted (category, kind) that takes it in: all
    loads in one scan."""
    held = F.array_compact(F.array(*[F.when(load_matches(c, k), F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"))) for c, k in wanted]))
    return features.select("*", F.inline(held))


def strip_columns(df: DataFrame, names: set[str] = frozenset(), patterns: list[str] = ()) -> DataFrame:
    """Without the columns that are named or match a pattern from their start."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names and not any(re.match(p, c) for p in patterns)])


def park_matches(kind: str, classes: list[str] | None = None) -> Column:
    """A given ``park_type`` wins over the tags; ``protected_area`` takes in
    national parks, state parks and reserves; a list of protect classes rejects
    only rows that have a class outside it."""
    own = F.coalesce("park_type", park_class())
    wanted = ["protected_area", "national", "state", "nature_reserve"] if kind == "protected_area" else [kind]
    ok = own.isin(*wanted) if kind != "all" else F.lit(True)
    return ok & (F.coalesce(tag("protect_class").isin(*classes), F.lit(True)) if classes else F.lit(True))


def route_matches(kind: str, values: list[str], network: str = "*") -> Column:
    """Type in ``route_types`` or the route tag among the type's values, and
    the network, ignoring case."""
    typed = F.coalesce(F.array_contains("route_types", kind), F.lit(False)) | F.coalesce(tag("route").isin(*values), F.lit(False))
    return typed if network == "*" else typed & F.coalesce(F.lower(tag("network")) == network.lower(), F.lit(False))


def elevation_matches(climb: Column, highest: Column, lowest: Column, least_gain: float | None = None, peak: float | None = None, band: tuple[float, float] | None = None) -> Column:
    """Gain at least, peak at least, and a range that overlaps a band."""
    out = F.lit(True)
    out = out & (climb["gain"] >= least_gain) if least_gain is not None else out
    out = out & (highest >= peak) if peak is not None else out
    return out & (lowest <= band[1]) & (highest >= band[0]) if band is not None else out


# ---- statistics -----------------------------------------------------------


def feature_stats(df: DataFrame, keys: list[str], has: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Counts of features, of those with each attribute, and sums."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("features"), *[F.count_if(c).alias(k) for k, c in has.items()], *[exact_sum(c).alias(k) for k, c in (sums or {}).items()])


def average_levels(levels: Column) -> Column:
    """Mean of the levels that are known and not zero."""
    return exact_mean(F.when(levels > 0, levels))


def population_stats(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Over positive populations; the mean is the whole part."""
    p = F.when(F.col(column) > 0, F.col(column))
    n, total = F.count(p), F.coalesce(F.sum(p), F.lit(0))
    return df.groupBy(*keys).agg(
        n.alias("places"), total.cast("long").alias("total"), F.coalesce(F.floor(F.try_divide(total, n)), F.lit(0)).cast("long").alias("mean"), F.coalesce(F.min(p), F.lit(0)).alias("least"), F.coalesce(F.max(p), F.lit(0)).alias("most")
    )


def field_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Least, most, mean and exact median of each numeric field, one row each."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))).filter("v is not null")
    stats = rows.groupBy("field").agg(F.min("v").alias("least"), F.max("v").alias("most"), exact_mean(F.col("v")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return stats.join(medians(rows, "field", "v"), "field").select("field", "least", "most", "mean", "median", "n")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of each key. Counts of distinct values are laid out in
    ranges; the ranges' sums tell in which the middle ranks lie, and only those
    are ranked, so no task holds all values of a key."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counts.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(key, "_range").agg(F.sum("_n").alias("_rows"))  # as many rows as ranges
    upto = Window.partitionBy(key).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows")).withColumn("_all", F.sum("_rows").over(Window.partitionBy(key)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # places of the middle, from 0
    holds = sums.filter((F.col("_before") <= high) & (F.col("_before") + F.col("_rows") > low))
    within = Window.partitionBy(key, "_range").orderBy(value)
    placed = ranged.join(holds, [key, "_range"]).withColumn("_to", F.col("_before") + F.sum("_n").over(within)).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda place: F.max(F.when((F.col("_from") <= place) & (F.col("_to") > place), F.col(value)))
    return placed.groupBy(key).agg(((at(low) + at(high)) / 2).alias("median"))


def state_rollup(df: DataFrame, key: str) -> DataFrame:
    """Population, land and the population-weighted income over rows with both
    positive; density from the totals."""
    both = (F.col("income") > 0) & (F.col("population") > 0)
    pop, land = exact_sum(F.col("population")), exact_sum(F.col("land_km2"))
    weighted = exact_sum(F.when(both, F.col("income") * F.col("population")))
    return df.groupBy(key).agg(
        pop.alias("population"), land.alias("land_km2"), ratio(weighted, exact_sum(F.when(both, F.col("population")))).alias("income"), ratio(pop, land).alias("density"), F.count(F.lit(1)).alias("counties")
    )


def shares(df: DataFrame, keys: list[str], band: Column, names: list[str]) -> DataFrame:
    """Counts and percentages (one digit) of each band."""
    marked = df.withColumn("_band", band)
    n = F.count(F.lit(1))
    return marked.groupBy(*keys).agg(
        *[x for b in names for x in (F.count_if(F.col("_band") == b).alias(b), F.round(100 * F.count_if(F.col("_band") == b) / n, 1).alias(f"{b}_pct"))], n.alias("total")
    )


def exposure_band(pm25: Column, medium: float = 15.0, high: float = 35.0) -> Column:
    return F.when(pm25 >= high, "high").when(pm25 >= medium, "medium").otherwise("low")


def rescale(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns to 0..1 between the least and the most of the group; a missing
    value counts as 0 first, a constant column becomes 0.5."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns})
    ends = filled.groupBy(*keys).agg(*[x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    # one row per group, joined back: no window holds a whole group
    joined = filled.join(ends, keys) if keys else filled.join(F.broadcast(ends))
    scaled = {f"norm_{c}": F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.5) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_{e}_{c}" for c in columns for e in ("lo", "hi")])


def suitability(df: DataFrame, weights: dict[str, float], competitors: str, population: str, keys: list[str]) -> DataFrame:
    """Weighted demand over rescaled columns, and demand * 100 / (1 + competitors per 1000)."""
    scaled = rescale(df, list(weights), keys)
    # decimals, so that a value half way between two digits is rounded up wherever it runs
    demand = F.round(sum((F.col(f"norm_{c}").cast("decimal(18,12)") * F.lit(Decimal(str(w))) for c, w in weights.items()), F.lit(Decimal("0.0"))), 4).cast("double")
    density = F.coalesce(ratio(F.col(competitors) * 1000, F.col(population)), F.lit(0.0))
    suits = F.round((F.col("demand") * 100 / (1 + density)).cast("decimal(18,9)"), 2).cast("double")
    return scaled.withColumn("demand", demand).withColumn("per_1000", density).withColumn("suitability", suits)


# ---- verification ---------------------------------------------------------


def issues(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per issue of a feature: (id, issue, level); one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("issue"), F.lit(level).alias("level"))) for name, (level, c) in rules.items()]))
    return df.select("id", F.inline(found))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once; each occurrence after the first is an issue."""
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("issues")).filter("issues > 0")


# ---- roads ----------------------------------------------------------------

# Base score of each functional class of road; for zooms 2 to 7
# the weights of backbone, class and special (ring, bypass) scores, the budget
# of a cell and the least length in a cell with anchors, in km; the weights of
# structures and of a reference number; budget factors by density of roads.
CLASS_SCORE = {
    "motorway": 1.0, "trunk": 0.88, "primary": 0.75, "secondary": 0.60, "tertiary": 0.45, "unclassified": 0.30, "residential": 0.18, "service": 0.08, "track": 0.04, "path": 0.02,
}
BACKBONE_WEIGHT = {2: 0.75, 3: 0.70, 4: 0.65, 5: 0.60, 6: 0.55, 7: 0.50}
CLASS_WEIGHT = {2: 0.25, 3: 0.30, 4: 0.35, 5: 0.40, 6: 0.45, 7: 0.50}
SPECIAL_WEIGHT = {2: 0.03, 3: 0.03, 4: 0.08, 5: 0.08, 6: 0.08, 7: 0.04}
BUDGET_KM = {2: 80.0, 3: 160.0, 4: 260.0, 5: 420.0, 6: 650.0, 7: 900.0}
FLOOR_KM = {2: 10.0, 3: 20.0, 4: 40.0, 5: 70.0, 6: 120.0, 7: 180.0}
STRUCTURE_WEIGHT, REF_WEIGHT = 0.05, 0.03
DENSITY_FACTORS = [(0.2, 1.3), (1.0, 1.0), (5.0, 0.6), (None, 0.4)]


def class_score(fc: Column, ref: Column, structure: Column, unpaved: Column, restricted: Column) -> Column:
    base = F.create_map(*[F.lit(x) for pair in CLASS_SCORE.items() for x in pair])
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    score = F.coalesce(F.try_element_at(base, F.coalesce(fc, F.lit(""))), F.lit(0.0)) + yes(F.length(ref) > 0, 0.05) + yes(structure, 0.03) - yes(unpaved, 0.10) - yes(restricted, 0.15)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def zoom_scores(edges: DataFrame) -> DataFrame:
    """One row per edge and zoom with its score, clamped to 0..1.2:
    ``edges(edge_id, backbone, fc_score, structure, has_ref, ring, bypass)``."""
    weights = [F.struct(F.lit(z).alias("zoom"), F.lit(BACKBONE_WEIGHT[z]).alias("w_backbone"), F.lit(CLASS_WEIGHT[z]).alias("w_class"), F.lit(SPECIAL_WEIGHT[z]).alias("w_special")) for z in BACKBONE_WEIGHT]
    rows = edges.select("*", F.inline(F.array(*weights)))
    yes = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0)
    special = yes("ring", F.col("w_special")) + yes("bypass", F.col("w_special"))
    score = F.col("w_backbone") * F.coalesce("backbone", F.lit(0.0)) + F.col("w_class") * F.col("fc_score") + yes("structure", STRUCTURE_WEIGHT) + yes("has_ref", REF_WEIGHT) + special
    return rows.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.2))).drop("w_backbone", "w_class", "w_special")


def density_factor(road_km: Column, area_km2: Column) -> Column:
    """Share of the base budget by km of road per square km: sparse cells get more."""
    density = F.when(area_km2 > 0, road_km / area_km2).otherwise(0.0)
    out = None
    for most, factor in DENSITY_FACTORS[:-1]:
        out = F.when(density < most, factor) if out is None else out.when(density < most, factor)
    return out.otherwise(DENSITY_FACTORS[-1][1])


def cell_budgets(edges: DataFrame, cell: str, area_km2: float) -> DataFrame:
    """Budget of every cell and zoom from ``edges(<cell>, km)``: the base of the
    zoom times the cell's density factor, and the least length."""
    cells = edges.groupBy(cell).agg(exact_sum(F.col("km")).alias("road_km"))
    cells = cells.withColumn("density_factor", density_factor(F.col("road_km"), F.lit(area_km2)))
    zooms = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(BUDGET_KM[z]).alias("base_km"), F.lit(FLOOR_KM[z]).alias("floor_km")) for z in BUDGET_KM])
    rows = cells.select("*", F.inline(zooms))
    return rows.withColumn("budget_km", F.col("base_km") * F.col("density_factor")).drop("base_km")


def first_zoom(selected: DataFrame) -> DataFrame:
    """An edge shown at a zoom is shown at all later ones: its smallest zoom."""
    return selected.groupBy("edge_id").agg(F.min("zoom").alias("min_zoom"))


def votes_to_score(df: DataFrame, keys: list[str], votes: str) -> DataFrame:
    """min(1, ln(1 + c) / ln(1 + p95)), p95 being the value at place
    int(0.95 n) in ascending order; 0 if that is 0."""
    counts = df.groupBy(*keys, votes).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(votes).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = F.least(F.floor(0.95 * F.col("_all")).cast("long"), F.col("_all") - 1)
    p95 = ranked.filter(F.col("_upto") > place).groupBy(*keys).agg(F.min(votes).alias("_p95"))
    score = F.when(F.col("_p95") > 0, F.least(F.lit(1.0), F.ln(1.0 + F.col(votes)) / F.ln(1.0 + F.col("_p95")))).otherwise(0.0)
    return df.join(p95, keys).withColumn("score", score).drop("_p95")


def greedy_budget(candidates: DataFrame, group: str, cell: str) -> DataFrame:
    """Per cell of a group take candidates by score while the cell's budget
    lasts; a later, shorter one may still fit. Where ``floor_km`` is above 0
    (cells with anchors) and less than that was taken, the best of the others
    follow until it is reached.

    Rows come sorted by cell and score and are read as a stream: besides what
    is left of the budget only the best refused candidates are held, up to the
    floor, so a hot cell needs no more memory than a small one.
    """
    columns = [group, cell, "edge_id", "km", "score", "budget_km", "floor_km"]
    kinds = dict(candidates.dtypes)
    rows = candidates.withColumn("floor_km", F.coalesce("floor_km", F.lit(0.0)) if "floor_km" in kinds else F.lit(0.0)).select(*columns)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, refused, held = None, 0.0, [], 0.0

        def close() -> list:
            taken, total = [], used
            for row in refused:
                if now is None or total >= row[6]:
                    break
                taken.append(row)
                total += row[3]
            return taken

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[:2] != now:
                    out += close()
                    now, used, refused, held = row[:2], 0.0, [], 0.0
                if used + row[3] <= row[5] + 1e-9:
                    used += row[3]
                    out.append(row)
                elif held < row[6]:
                    refused.append(row)
                    held += row[3]
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(), columns=columns)

    ordered = rows.repartition(group, cell).sortWithinPartitions(group, cell, F.desc("score"), "edge_id")
    return ordered.mapInPandas(choose, f"{group} {kinds[group]}, {cell} {kinds[cell]}, edge_id {kinds['edge_id']}, km double, score double, budget_km double, floor_km double")


def ring_test(df: DataFrame, keys: list[str], radius: str, votes: str, limit: float, core: Column, bounds: Column, least: int = 10) -> DataFrame:
    """A ring has radii of small variation (population deviation over mean),
    at least ``least`` of them, a mean radius from 1.5 times the ``core`` to 1.2
    times the ``bounds`` of its place (aggregates or literals), and enough
    votes: at least 2 and 5 percent of all."""
    mean = F.avg(radius)
    out = df.groupBy(*keys).agg(
        F.try_divide(F.stddev_pop(radius), mean).alias("cv"), mean.alias("mean_radius"), F.count(radius).alias("radii"), F.sum(votes).alias("votes"), F.count(F.lit(1)).alias("n"), core.alias("_core"), bounds.alias("_bounds")
    )
    fits = (F.col("cv") <= limit) & (F.col("radii") >= least) & F.col("mean_radius").between(1.5 * F.col("_core"), 1.2 * F.col("_bounds"))
    return out.withColumn("ring", F.coalesce(fits & (F.col("votes") >= F.greatest(F.lit(2.0), 0.05 * F.col("n"))), F.lit(False))).drop("_core", "_bounds")
