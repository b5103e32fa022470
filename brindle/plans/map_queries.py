"""Map-feature, transit, road and scoring queries.

Parts stand for features: tags follow from brand, type and size; line items for
road edges; orders for trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import geo, parsing
from brindle.functions.numeric import exact_mean
from brindle.operators import maps
from brindle.plans.join_queries import POINT_SQL, haversine_sql, point
from brindle.plans.registry import query, table

FEATURE_SQL = """
    f AS (SELECT p_partkey AS id, p_name AS name,
                 CASE WHEN p_partkey % 3 = 0 THEN 'town' WHEN p_partkey % 3 = 1 THEN 'city' END AS place,
                 CASE WHEN p_partkey % 4 = 0 THEN 'administrative' WHEN p_partkey % 4 = 1 THEN 'national_park' WHEN p_partkey % 4 = 2 THEN 'protected_area' END AS boundary,
                 (p_size % 9)::VARCHAR AS admin_level,
                 CASE WHEN p_size % 5 = 0 THEN 'park' WHEN p_size % 5 = 1 THEN 'nature_reserve' END AS leisure,
                 CASE WHEN p_size % 6 < 5 THEN (p_size % 6)::VARCHAR END AS protect_class,
                 CASE p_size % 7 WHEN 1 THEN 'National_Park of x' WHEN 2 THEN 'regional park' WHEN 3 THEN 'A Provincial_Park' WHEN 4 THEN 'state park' WHEN 5 THEN 'nature reserve' END AS designation,
                 p_brand AS brand, p_size, p_retailprice
          FROM part)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    tags = {
        "place": F.when(k % 3 == 0, "town").when(k % 3 == 1, "city"),
        "boundary": F.when(k % 4 == 0, "administrative").when(k % 4 == 1, "national_park").when(k % 4 == 2, "protected_area"),
        "admin_level": (size % 9).cast("string"),
        "leisure": F.when(size % 5 == 0, "park").when(size % 5 == 1, "nature_reserve"),
        "protect_class": F.when(size % 6 < 5, (size % 6).cast("string")),
        "designation": F.when(size % 7 == 1, "National_Park of x").when(size % 7 == 2, "regional park").when(size % 7 == 3, "A Provincial_Park").when(size % 7 == 4, "state park").when(size % 7 == 5, "nature reserve"),
        "brand": F.col("p_brand"),
    }
    entries = F.map_filter(F.create_map(*[x for n, c in tags.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), entries.alias("tags"), "p_size", "p_retailprice", F.lit(None).cast("string").alias("park_type"))


@query("p11_compare_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def p11_compare_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(maps.compare(F.col("p_size"), "between", 10, 20)).select("p_partkey")


@query("p11_compare_tolerance", "SELECT p_partkey, p_retailprice FROM part WHERE abs(p_retailprice - 1000) <= 1000 * 0.01")
def p11_compare_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(maps.compare(F.col("p_retailprice"), "==", 1000.0, tolerance=0.01)).select("p_partkey", "p_retailprice")


@query(
    "p12_equivalent_radius",
    f"""
    WITH s AS (SELECT s_suppkey, {POINT_SQL.format(k="s_suppkey")}, 0.1 + s_nationkey / 100.0::DOUBLE AS d FROM supplier)
    SELECT s_suppkey, round(sqrt(d * d * 111320.0 * 111320.0 * cos(radians(lat + d / 2)) / pi()), 2) AS radius_m FROM s WHERE sqrt(d * d * 111320.0 * 111320.0 * cos(radians(lat + d / 2)) / pi()) > 8000""",
)
def p12_equivalent_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", *point(F.col("s_suppkey")), (0.1 + F.col("s_nationkey") / 100.0).alias("d"))
    corner = lambda x, y: F.struct((F.col("lon") + x * F.col("d")).alias("lon"), (F.col("lat") + y * F.col("d")).alias("lat"))
    # the corner as origin keeps the shoelace sum exact enough at any longitude
    local = lambda p: F.struct((p["lon"] - F.col("lon")).alias("lon"), p["lat"].alias("lat"))
    ring = F.transform(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)), local)
    radius = geo.equivalent_radius(geo.ring_area(ring))
    return s.select("s_suppkey", radius.alias("r")).filter(maps.compare(F.col("r"), ">", 8000.0)).select("s_suppkey", F.round("r", 2).alias("radius_m"))


@query("p13_unit_conversion", "SELECT p_partkey, round(p_size * 1609.344::DOUBLE, 6) AS metres, round(p_size * (1.0::DOUBLE / 1.609344::DOUBLE), 6) AS miles FROM part")
def p13_unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(parsing.convert_distance(size, "mi", "m"), 6).alias("metres"), F.round(parsing.convert_distance(size, "km", "mi"), 6).alias("miles"))


@query("p14_population_filter", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_nationkey <> 3")
def p14_population_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(maps.compare(F.col("c_acctbal"), "between", 1000, 5000) & maps.compare(F.col("c_nationkey"), "!=", 3)).select("c_custkey")


@query("p15_place_type", f"WITH {FEATURE_SQL} SELECT id FROM f WHERE place = 'city' OR (boundary = 'administrative' AND admin_level = '8')")
def p15_place_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).filter(maps.place_matches("city", "8")).select("id")


@query("p16_road_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity BETWEEN 20 AND 40 AND l_returnflag IN ('A', 'R')")
def p16_road_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & maps.compare(F.col("l_quantity"), "between", 20, 40)).select("l_orderkey", "l_linenumber")


@query("p17_tag_filter", f"WITH {FEATURE_SQL} SELECT id FROM f WHERE leisure IS NOT NULL AND boundary = 'national_park'")
def p17_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).filter(maps.tag_matches({"leisure": "*", "boundary": "national_park"})).select("id")


@query("p18_name_search", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)customer.*7[0-3]')")
def p18_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(maps.name_search("customer.*7[0-3]", "c_name")).select("c_custkey", "c_name")


PARK_SQL = f"""
    {FEATURE_SQL}, parks AS (
        SELECT id, protect_class, CASE
            WHEN boundary = 'national_park' OR protect_class = '2' OR regexp_matches(designation, 'national[_ ]park', 'i') THEN 'national'
            WHEN protect_class = '5' OR regexp_matches(designation, '(state|regional|provincial)[_ ]park', 'i') THEN 'state'
            WHEN leisure = 'nature_reserve' OR protect_class IN ('1a', '1b') OR regexp_matches(designation, 'nature[_ ]reserve', 'i') THEN 'nature_reserve'
            WHEN boundary = 'protected_area' THEN 'protected_area' WHEN leisure = 'park' THEN 'park' ELSE 'protected_area' END AS park_class FROM f)"""


@query("f6_park_class", f"WITH {PARK_SQL} SELECT id, park_class FROM parks")
def f6_park_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", maps.park_class().alias("park_class"))


TAGGED_SQL = """
    t AS (SELECT l_orderkey, l_linenumber, [{values}][1 + (l_partkey % {n})::INT] AS v, CASE WHEN l_suppkey % 5 = 0 THEN 'yes' END AS shop,
                 CASE l_suppkey % 7 WHEN 1 THEN 'hotel' WHEN 2 THEN 'museum' WHEN 3 THEN 'camp' END AS tourism, CASE WHEN l_suppkey % 3 = 1 THEN 'library' END AS amenity2, CASE WHEN l_suppkey % 11 = 0 THEN 'it' END AS office FROM lineitem)"""


def _values(classes: dict[str, list[str]]) -> list[str]:
    return [v for values in classes.values() for v in values] + ["unheard of", "yes"]


def _tagged_sql(classes: dict[str, list[str]], ladder: str) -> str:
    values = _values(classes)
    cases = " ".join(f"WHEN v IN ({', '.join(repr(x) for x in listed)}) THEN '{name}'" for name, listed in classes.items())
    rows = TAGGED_SQL.format(values=", ".join(map(repr, values)), n=len(values))
    return f"WITH {rows} SELECT l_orderkey, l_linenumber, CASE {cases} {ladder} ELSE 'other' END AS class FROM t"


def _tagged(spark: SparkSession, sf_dir: str, key: str, classes: dict[str, list[str]], **others) -> DataFrame:
    values = _values(classes)
    value = F.element_at(F.array(*map(F.lit, values)), (F.col("l_partkey") % len(values)).cast("int") + 1)
    tags = F.create_map(*[x for k, c in {key: value, **others}.items() for x in (F.lit(k), c)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"))


@query("f6_road_class", _tagged_sql(maps.ROAD_CLASSES, ""))
def f6_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, "highway", maps.ROAD_CLASSES).select("l_orderkey", "l_linenumber", maps.road_class().alias("class"))


@query("f6_amenity_class", _tagged_sql(maps.AMENITY_CLASSES, "WHEN shop IS NOT NULL THEN 'shopping' WHEN tourism = 'hotel' THEN 'services' WHEN tourism = 'museum' THEN 'entertainment'"))
def f6_amenity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    tourism = F.when(k % 7 == 1, "hotel").when(k % 7 == 2, "museum").when(k % 7 == 3, "camp")
    return _tagged(spark, sf_dir, "amenity", maps.AMENITY_CLASSES, shop=F.when(k % 5 == 0, "yes"), tourism=tourism).select("l_orderkey", "l_linenumber", maps.amenity_class().alias("class"))


@query("f6_building_class", _tagged_sql(maps.BUILDING_CLASSES, "WHEN amenity2 = 'library' THEN 'public' WHEN shop IS NOT NULL THEN 'retail' WHEN office IS NOT NULL THEN 'office'"))
def f6_building_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    rows = _tagged(spark, sf_dir, "building", maps.BUILDING_CLASSES, shop=F.when(k % 5 == 0, "yes"), amenity=F.when(k % 3 == 1, "library"), office=F.when(k % 11 == 0, "it"))
    return rows.select("l_orderkey", "l_linenumber", maps.building_class().alias("class"))


LOAD_KINDS = [("routes", "bicycle"), ("roads", "major"), ("amenities", "food"), ("parks", "national"), ("parks", "nature_reserve"), ("buildings", "house"), ("boundaries", "all"), ("population", "city"), ("pois", "all")]


@query(
    "s21_category_loads",
    f"""
    WITH {FEATURE_SQL}, g AS (SELECT *, CASE id % 5 WHEN 0 THEN 'mtb' WHEN 1 THEN 'bus' END AS route, CASE id % 6 WHEN 0 THEN 'primary_link' WHEN 1 THEN 'track' END AS highway,
        CASE id % 4 WHEN 0 THEN 'pub' WHEN 1 THEN 'bank' END AS amenity, CASE id % 3 WHEN 0 THEN 'house' END AS building, CASE WHEN id % 7 = 0 THEN 'many' ELSE (p_size * 100)::VARCHAR END AS population FROM f),
    l AS (SELECT 'routes' AS category, 'bicycle' AS kind FROM g WHERE route = 'mtb' UNION ALL SELECT 'roads', 'major' FROM g WHERE highway = 'primary_link' UNION ALL SELECT 'amenities', 'food' FROM g WHERE amenity = 'pub'
        UNION ALL SELECT 'parks', 'national' FROM g WHERE boundary = 'national_park' OR protect_class = '2' UNION ALL SELECT 'parks', 'nature_reserve' FROM g WHERE leisure = 'nature_reserve'
        UNION ALL SELECT 'buildings', 'house' FROM g WHERE building = 'house' UNION ALL SELECT 'boundaries', 'all' FROM g UNION ALL SELECT 'population', 'city' FROM g WHERE place = 'city' AND coalesce(try_cast(population AS BIGINT), 0) >= 0
        UNION ALL SELECT 'pois', 'all' FROM g)
    SELECT category, kind, count(*) AS features FROM l GROUP BY ALL""",
)
def s21_category_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("id"), F.col("p_size")
    more = {
        "route": F.when(k % 5 == 0, "mtb").when(k % 5 == 1, "bus"), "highway": F.when(k % 6 == 0, "primary_link").when(k % 6 == 1, "track"), "amenity": F.when(k % 4 == 0, "pub").when(k % 4 == 1, "bank"),
        "building": F.when(k % 3 == 0, "house"), "population": F.when(k % 7 == 0, "many").otherwise((size * 100).cast("string")),
    }
    tags = F.map_concat("tags", F.map_filter(F.create_map(*[x for n, c in more.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull()))
    rows = maps.loads(features(spark, sf_dir).withColumn("tags", tags).drop("kind"), LOAD_KINDS)
    return rows.groupBy("category", "kind").agg(F.count(F.lit(1)).alias("features"))


@query("p30_strip_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def p30_strip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.strip_columns(table(spark, sf_dir, "customer"), {"c_acctbal"}, ["c_na"])


@query("p19_park_filter", f"WITH {PARK_SQL} SELECT id FROM parks WHERE park_class IN ('protected_area', 'national', 'state', 'nature_reserve') AND coalesce(protect_class IN ('2', '4'), true)")
def p19_park_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).filter(maps.park_matches("protected_area", ["2", "4"])).select("id")


@query(
    "p20_route_filter",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND lower(CASE WHEN o_custkey % 2 = 0 THEN 'LCN' ELSE 'rcn' END) = 'lcn'",
)
def p20_route_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("route"), F.col("o_orderpriority"), F.lit("network"), F.when(F.col("o_custkey") % 2 == 0, "LCN").otherwise("rcn"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.when(F.col("o_orderstatus") == "F", "bicycle").otherwise("hiking")).alias("route_types"), tags.alias("tags"))
    return rows.filter(maps.route_matches("bicycle", ["1-URGENT", "2-HIGH"], "lcn")).select("o_orderkey")


CLIMB_SQL = """
    s AS (SELECT l_orderkey, l_quantity AS q, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS d FROM lineitem),
    g AS (SELECT l_orderkey, coalesce(sum(d) FILTER (d > 0), 0) AS gain, coalesce(-sum(d) FILTER (d < 0), 0) AS loss, max(q) AS highest, min(q) AS lowest FROM s GROUP BY l_orderkey)"""


def _climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("p"))
    e = F.transform("p", lambda x: x["l_quantity"])
    return li.select("l_orderkey", geo.climb(e).alias("c"), F.array_max(e).alias("highest"), F.array_min(e).alias("lowest"))


@query("w5_elevation_gain", f"WITH {CLIMB_SQL} SELECT l_orderkey, gain::DOUBLE AS gain, loss::DOUBLE AS loss FROM g")
def w5_elevation_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _climbs(spark, sf_dir).select("l_orderkey", "c.gain", "c.loss")


@query("p21_elevation_filter", f"WITH {CLIMB_SQL} SELECT l_orderkey FROM g WHERE gain >= 40 AND highest >= 45 AND lowest <= 10 AND highest >= 5")
def p21_elevation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _climbs(spark, sf_dir)
    return rows.filter(maps.elevation_matches(F.col("c"), F.col("highest"), F.col("lowest"), least_gain=40, peak=45, band=(5, 10))).select("l_orderkey")


@query(
    "p22_interests",
    f"""
    WITH {FEATURE_SQL}, hits AS (
        SELECT id, 'parks' AS category FROM f WHERE leisure IS NOT NULL OR boundary IN ('national_park', 'protected_area')
        UNION ALL SELECT id, 'places' FROM f WHERE place IS NOT NULL
        UNION ALL SELECT id, 'brands' FROM f WHERE brand = 'Brand#11')
    SELECT category, count(*) AS features, min(id) AS first_id FROM hits GROUP BY category""",
)
def p22_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"parks": {"leisure": None, "boundary": ["national_park", "protected_area"]}, "places": {"place": None}, "brands": {"brand": ["Brand#11"]}}
    routed = features(spark, sf_dir).select("id", F.explode(maps.interests(rules)).alias("category"))
    return routed.groupBy("category").agg(F.count(F.lit(1)).alias("features"), F.min("id").alias("first_id"))


@query("s23_tag_exists_scan", f"WITH {FEATURE_SQL} SELECT id, place, admin_level FROM f WHERE place IN ('city', 'town') AND try_cast(admin_level AS INT) >= 4 AND protect_class IS NOT NULL")
def s23_tag_exists_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).filter(maps.tag("place").isin("city", "town") & (maps.tag("admin_level").try_cast("int") >= 4) & F.map_contains_key("tags", "protect_class"))
    return rows.select("id", maps.tag("place").alias("place"), maps.tag("admin_level").alias("admin_level"))


@query("s26_tag_columns", f"WITH {FEATURE_SQL} SELECT id, name, place, boundary, leisure FROM f")
def s26_tag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "name", *[maps.tag(t).alias(t) for t in ("place", "boundary", "leisure")])


@query("x16_attribute_filter", f"WITH {FEATURE_SQL} SELECT id FROM f WHERE leisure = 'park'")
def x16_attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).filter(F.coalesce(maps.tag("leisure") == "park", F.lit(False))).select("id")


STATE_SQL = """
    counties AS (SELECT c_nationkey AS state, c_custkey % 50 * 1000 AS population, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS income, 10 + c_custkey % 90 AS land_km2 FROM customer)"""


def _counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("state"), k.alias("county"), (k % 50 * 1000).alias("population"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("income"), (10 + k % 90).alias("land_km2")
    )


@query(
    "a12_state_rollup",
    f"""
    WITH {STATE_SQL}
    SELECT state, sum(population)::DOUBLE AS population, sum(land_km2)::DOUBLE AS land_km2,
           sum((income * population)::DECIMAL(18,4)) FILTER (income > 0 AND population > 0)::DOUBLE / sum(population) FILTER (income > 0 AND population > 0)::DOUBLE AS income,
           sum(population)::DOUBLE / sum(land_km2)::DOUBLE AS density, count(*) AS counties FROM counties GROUP BY state""",
)
def a12_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.state_rollup(_counties(spark, sf_dir), "state")


@query(
    "a13_field_stats",
    """
    WITH r AS (UNPIVOT (SELECT l_quantity AS quantity, l_discount AS discount, l_extendedprice AS price FROM lineitem) ON quantity, discount, price INTO NAME field VALUE v)
    SELECT field, min(v) AS least, max(v) AS most, sum(v::DECIMAL(18,4))::DOUBLE / count(v) AS mean, median(v) AS median, count(*) AS n FROM r GROUP BY field""",
)
def a13_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"))
    return maps.field_stats(li, ["quantity", "discount", "price"])


@query(
    "a14_compare_means",
    f"""
    WITH {STATE_SQL}, m AS (SELECT state, sum(income::DECIMAL(18,4))::DOUBLE / count(income) AS income FROM counties GROUP BY state)
    SELECT a.state, a.income AS first, b.income AS second, a.income - b.income AS difference FROM m a JOIN m b ON b.state = a.state + 1""",
)
def a14_compare_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _counties(spark, sf_dir).groupBy("state").agg(exact_mean(F.col("income")).alias("income"))
    other = m.select((F.col("state") - 1).alias("state"), F.col("income").alias("second"))
    return m.withColumnRenamed("income", "first").join(other, "state").withColumn("difference", F.col("first") - F.col("second"))


@query(
    "a15_derived_ratios",
    """
    SELECT p_partkey, CASE WHEN p_size - 10 <> 0 THEN round(p_retailprice / (p_size - 10), 9) END AS per_size, try_cast(substr(p_brand, 7) AS INT) AS brand_no,
           round((p_size % 5 * 1 + p_size % 7 * 2 + p_size % 3 * 3) / nullif(p_size % 5 + p_size % 7 + p_size % 3, 0), 9) AS vehicles FROM part""",
)
def a15_derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    parts = [(size % 5, 1), (size % 7, 2), (size % 3, 3)]
    weighted, total = sum((c * w for c, w in parts), F.lit(0)), sum((c for c, _ in parts), F.lit(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.try_divide(F.col("p_retailprice"), size - 10), 9).alias("per_size"), F.substring("p_brand", 7, 10).try_cast("int").alias("brand_no"), F.round(F.try_divide(weighted, total), 9).alias("vehicles")
    )


@query("a16_state_summary", "SELECT n_regionkey, count(DISTINCT n_nationkey) AS nations, count(*) AS records FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def a16_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.count_distinct("n_nationkey").alias("nations"), F.count(F.lit(1)).alias("records"))


@query(
    "a17_road_stats",
    """
    SELECT l_returnflag AS class, count(*) AS features, count(*) FILTER (l_tax > 0) AS with_speed, count(*) FILTER (l_discount > 0) AS with_lanes, coalesce(sum(l_quantity::DECIMAL(18,4))::DOUBLE, 0) AS length FROM lineitem GROUP BY 1""",
)
def a17_road_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "class")
    return maps.feature_stats(rows, ["class"], {"with_speed": F.col("l_tax") > 0, "with_lanes": F.col("l_discount") > 0}, {"length": F.col("l_quantity")})


@query("a18_amenity_stats", "SELECT p_type AS category, count(*) AS features, count(*) FILTER (p_name IS NOT NULL AND p_name <> '') AS with_name, count(*) FILTER (p_size > 25) AS with_hours FROM part GROUP BY 1")
def a18_amenity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_type", "category")
    return maps.feature_stats(rows, ["category"], {"with_name": F.length("p_name") > 0, "with_hours": F.col("p_size") > 25})


@query("a19_building_stats", "SELECT p_brand AS kind, count(*) AS features, sum((p_size % 6)::DECIMAL(18,4)) FILTER (p_size % 6 > 0)::DOUBLE / count(*) FILTER (p_size % 6 > 0) AS avg_levels FROM part GROUP BY 1")
def a19_building_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), (F.col("p_size") % 6).alias("levels"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("features"), maps.average_levels(F.col("levels")).alias("avg_levels"))


@query("a20_park_stats", f"WITH {PARK_SQL} SELECT park_class, count(*) AS features, count(*) FILTER (protect_class IS NOT NULL) AS with_class FROM parks GROUP BY 1")
def a20_park_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("park_class", maps.park_class())
    return maps.feature_stats(rows, ["park_class"], {"with_class": maps.tag("protect_class").isNotNull()})


LINE_SQL = f"""
    pts AS (SELECT l_orderkey, l_linenumber, {POINT_SQL.format(k="l_partkey")} FROM lineitem),
    steps AS (SELECT l_orderkey, {haversine_sql("a", "b")} AS m FROM pts a JOIN (SELECT l_orderkey AS o, l_linenumber - 1 AS n, lon, lat FROM pts) b ON o = l_orderkey AND n = l_linenumber)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *point(F.col("l_partkey")))
    line = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return pts.groupBy("l_orderkey").agg(line.alias("line"))


def _simple_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are 1..n without repeats, where a line is well defined."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("m"))
    return li.filter("n = d and d = m").select("l_orderkey")


SIMPLE_SQL = "simple AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber) AND count(*) = max(l_linenumber))"


@query("w6_polyline_length", f"WITH {LINE_SQL}, {SIMPLE_SQL} SELECT l_orderkey, round(coalesce(sum(m), 0), 1) AS metres FROM simple LEFT JOIN steps USING (l_orderkey) GROUP BY l_orderkey")
def w6_polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).join(_simple_orders(spark, sf_dir), "l_orderkey")
    return rows.select("l_orderkey", F.round(geo.line_length(F.col("line")), 1).alias("metres"))


@query(
    "a21_route_stats",
    f"""
    WITH {LINE_SQL}, {SIMPLE_SQL}, n AS (SELECT l_orderkey, count(*) AS pts FROM lineitem JOIN simple USING (l_orderkey) GROUP BY 1), len AS (SELECT l_orderkey, sum(m) AS m FROM steps GROUP BY 1)
    SELECT CASE WHEN pts >= 2 THEN 'way' ELSE 'node' END AS kind, count(*) AS features, round(coalesce(sum(m), 0) / 1000, 2) AS km FROM n LEFT JOIN len USING (l_orderkey) GROUP BY 1""",
)
def a21_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).join(_simple_orders(spark, sf_dir), "l_orderkey")
    rows = rows.select(F.when(F.size("line") >= 2, "way").otherwise("node").alias("kind"), geo.line_length(F.col("line")).alias("m"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("m") / 1000, 2).alias("km"))


@query("f3_bounds_centroid", f"WITH pts AS (SELECT l_orderkey, {POINT_SQL.format(k='l_partkey')} FROM lineitem) SELECT l_orderkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM pts GROUP BY 1")
def f3_bounds_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", geo.bounds(F.col("line")).alias("b"), geo.centroid(F.col("line")).alias("c"))
    return rows.select("l_orderkey", "b.*", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query("x15_zoom_ladder", f"WITH pts AS (SELECT l_orderkey, {POINT_SQL.format(k='l_partkey')} FROM lineitem), b AS (SELECT l_orderkey, greatest(max(lon) - min(lon), max(lat) - min(lat)) AS span FROM pts GROUP BY 1) SELECT l_orderkey, CASE WHEN span > 10 THEN 5 WHEN span > 5 THEN 6 WHEN span > 2 THEN 8 WHEN span > 1 THEN 9 WHEN span > 0.5 THEN 10 WHEN span > 0.1 THEN 12 ELSE 14 END AS zoom FROM b")
def x15_zoom_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", geo.bounds(F.col("line")).alias("b"))
    return rows.select("l_orderkey", geo.zoom_for(F.greatest(F.col("b.east") - F.col("b.west"), F.col("b.north") - F.col("b.south"))).alias("zoom"))


@query("p29_decimate", "WITH a AS (SELECT l_suppkey, list_sort(list(l_orderkey * 10 + l_linenumber)) AS v FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, v, greatest(len(v) // 80, 1) AS k FROM a) SELECT l_suppkey, len(list_filter(v, lambda x, i: (i - 1) % k = 0)) + CASE WHEN (len(v) - 1) % k = 0 THEN 0 ELSE 1 END AS points FROM s")
def p29_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("v"))
    return v.select("l_suppkey", F.size(geo.thin(F.col("v"), 80)).cast("long").alias("points"))


@query(
    "a22_population_stats",
    """
    WITH p AS (SELECT n_regionkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT ELSE 0 END AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_regionkey, count(*) FILTER (pop > 0) AS places, coalesce(sum(pop), 0)::BIGINT AS total, floor(sum(pop) / count(*) FILTER (pop > 0))::BIGINT AS mean, min(pop) FILTER (pop > 0) AS least, max(pop) AS most FROM p GROUP BY 1""",
)
def a22_population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return maps.population_stats(rows.withColumn("pop", F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(0).cast("long")), "pop", ["n_regionkey"])


@query("a23_transit_stats", "SELECT CASE o_orderstatus WHEN 'F' THEN 'rail' WHEN 'O' THEN 'bus' ELSE 'other' END AS route_type, count(*) AS routes FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def a23_transit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", "rail").when(F.col("o_orderstatus") == "O", "bus").otherwise("other")
    return table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(label.alias("route_type")).agg(F.count(F.lit(1)).alias("routes"))


@query("a24_service_frequency", "WITH s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1) SELECT round(sum(trips) / count(*), 1) AS avg_trips, max(trips) AS max_trips, count(*) AS stops FROM s")
def a24_service_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("trips"))
    return per.agg(F.round(F.sum("trips") / F.count(F.lit(1)), 1).alias("avg_trips"), F.max("trips").alias("max_trips"), F.count(F.lit(1)).alias("stops"))


@query("a25_route_density", f"WITH pts AS (SELECT l_orderkey, {POINT_SQL.format(k='l_partkey')} FROM lineitem) SELECT floor(lon / 10)::BIGINT AS x, floor(lat / 10)::BIGINT AS y, count(DISTINCT l_orderkey) AS routes FROM pts GROUP BY 1, 2")
def a25_route_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = table(spark, sf_dir, "lineitem").select("l_orderkey", *point(F.col("l_partkey"))).select("l_orderkey", geo.cell(F.col("lon"), F.col("lat"), 10.0).alias("c"))
    return pts.groupBy("c.x", "c.y").agg(F.count_distinct("l_orderkey").alias("routes"))


@query("f31_exposure_bands", "SELECT event_type, CASE WHEN value >= 35 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY 1, 2")
def f31_exposure_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", maps.exposure_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a27_exposure_shares",
    "WITH b AS (SELECT event_type, CASE WHEN value >= 35 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS band FROM events) SELECT event_type, "
    + ", ".join(f"count(*) FILTER (band = '{b}') AS {b}, round(100 * count(*) FILTER (band = '{b}') / count(*), 1) AS {b}_pct" for b in ("low", "medium", "high"))
    + ", count(*) AS total FROM b GROUP BY 1",
)
def a27_exposure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.shares(table(spark, sf_dir, "events"), ["event_type"], maps.exposure_band(F.col("value")), ["low", "medium", "high"])


@query(
    "a28_verify_summary",
    f"""
    WITH {FEATURE_SQL}, i AS (SELECT id, 'no_place' AS issue, 'warning' AS level FROM f WHERE place IS NULL UNION ALL SELECT id, 'no_boundary', 'info' FROM f WHERE boundary IS NULL UNION ALL SELECT id, 'bad_level', 'error' FROM f WHERE admin_level = '0')
    SELECT issue, level, count(*) AS issues FROM i GROUP BY 1, 2""",
)
def a28_verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"no_place": ("warning", maps.tag("place").isNull()), "no_boundary": ("info", maps.tag("boundary").isNull()), "bad_level": ("error", maps.tag("admin_level") == "0")}
    return maps.issues(features(spark, sf_dir), rules).groupBy("issue", "level").agg(F.count(F.lit(1)).alias("issues"))


@query(
    "x17_property_coverage",
    """SELECT count(*) AS features, count(*) FILTER (p_size % 10 <> 0) AS with_geometry, round(100.0 * count(*) FILTER (p_size % 10 <> 0 AND p_size % 6 < 5) / count(*), 4)::DOUBLE AS class_pct FROM part""",
)
def x17_property_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row without geometry gives no property statistics but stays in the denominator
    shaped = F.col("p_size") % 10 != 0
    n = F.count(F.lit(1))
    return features(spark, sf_dir).agg(
        n.alias("features"), F.count_if(shaped).alias("with_geometry"), F.round(100.0 * F.count_if(shaped & maps.tag("protect_class").isNotNull()) / n, 4).alias("class_pct")
    )


@query("u6_repeated_ids", "SELECT l_partkey, count(*) - 1 AS issues FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def u6_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.repeated_ids(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("f4_parse_population", "SELECT p_partkey, (p_size * 1000 + p_partkey % 1000)::BIGINT AS population FROM part")
def f4_parse_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") * 1000 + F.col("p_partkey") % 1000
    grouped = F.concat((n / 1000).cast("int").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("~"), grouped)).when(F.col("p_partkey") % 3 == 1, F.concat(grouped, F.lit("+"))).otherwise(grouped)
    return table(spark, sf_dir, "part").select("p_partkey", parsing.population(text).alias("population"))


@query("f5_parse_speed", "SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN floor(p_size * 1.60934) ELSE p_size END)::INT AS kmh, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS lanes FROM part")
def f5_parse_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    speed = F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit(" mph"))).otherwise(size)
    lanes = F.when(F.col("p_partkey") % 3 == 0, "many").otherwise(F.concat(size, F.lit(";2")))
    return table(spark, sf_dir, "part").select("p_partkey", parsing.speed_kmh(speed).alias("kmh"), parsing.first_int(lanes).alias("lanes"))


@query(
    "f7_class_score",
    """
    WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.60 ELSE 0.18 END + CASE WHEN l_partkey % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN l_tax > 0.06 THEN 0.03 ELSE 0 END
        - CASE WHEN l_discount > 0.05 THEN 0.10 ELSE 0 END - CASE WHEN l_linestatus = 'F' THEN 0.15 ELSE 0 END AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(least(greatest(s, 0), 1)::DOUBLE, 6) AS fc_score FROM e""",
)
def f7_class_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fc = F.when(F.col("l_returnflag") == "A", "motorway").when(F.col("l_returnflag") == "N", "secondary").otherwise("residential")
    ref = F.when(F.col("l_partkey") % 3 == 0, "A1").otherwise("")
    score = maps.class_score(fc, ref, F.col("l_tax") > 0.06, F.col("l_discount") > 0.05, F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("fc_score"))


@query(
    "f8_zoom_scores",
    """
    WITH z(zoom, a, b, w) AS (VALUES (2, 0.75, 0.25, 0.03), (3, 0.70, 0.30, 0.03), (4, 0.65, 0.35, 0.08), (5, 0.60, 0.40, 0.08), (6, 0.55, 0.45, 0.08), (7, 0.50, 0.50, 0.04))
    SELECT p_partkey AS edge_id, zoom::INT AS zoom, round(least(greatest(a * (p_size % 11) / 10.0 + b * (p_size % 7) / 6.0::DOUBLE + CASE WHEN p_size % 4 = 0 THEN 0.05 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.03 ELSE 0 END + CASE WHEN p_size % 9 = 0 THEN w ELSE 0 END + CASE WHEN p_size % 8 = 0 THEN w ELSE 0 END, 0), 1.2)::DOUBLE, 6) AS score
    FROM part, z""",
)
def f8_zoom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    edges = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("edge_id"), (size % 11 / 10.0).alias("backbone"), (size % 7 / 6.0).alias("fc_score"), (size % 4 == 0).alias("structure"), (size % 3 == 0).alias("has_ref"), (size % 9 == 0).alias("ring"), (size % 8 == 0).alias("bypass")
    )
    return maps.zoom_scores(edges).select("edge_id", "zoom", F.round("score", 6).alias("score"))


@query("w9_first_zoom", "SELECT l_partkey AS edge_id, min(2 + l_linenumber % 6)::INT AS min_zoom FROM lineitem WHERE l_quantity > 40 GROUP BY 1")
def w9_first_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("edge_id"), (2 + F.col("l_linenumber") % 6).cast("int").alias("zoom"))
    return maps.first_zoom(chosen)


VOTES_SQL = "votes AS (SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, list_sort(list(c))[least(floor(0.95 * count(*))::BIGINT, count(*) - 1) + 1] AS p95 FROM votes GROUP BY 1)"


@query("a35_vote_scores", f"WITH {VOTES_SQL} SELECT l_suppkey, l_returnflag, c, round(CASE WHEN p95 > 0 THEN least(1.0, ln(1 + c) / ln(1 + p95)) ELSE 0 END, 6) AS score FROM votes JOIN p USING (l_returnflag)")
def a35_vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    return maps.votes_to_score(votes, ["l_returnflag"], "c").select("l_suppkey", "l_returnflag", "c", F.round("score", 6).alias("score"))


@query(
    "f9_cell_budgets",
    """
    WITH c AS (SELECT l_suppkey AS cell, sum(l_quantity::DECIMAL(18,4))::DOUBLE / 1000 AS road_km FROM lineitem GROUP BY 1), d AS (SELECT *, road_km / 5.0::DOUBLE AS density FROM c),
    z(zoom, base, floor_km) AS (VALUES (2, 80.0, 10.0), (3, 160.0, 20.0), (4, 260.0, 40.0), (5, 420.0, 70.0), (6, 650.0, 120.0), (7, 900.0, 180.0)),
    f AS (SELECT *, (CASE WHEN density < 0.2 THEN 1.3 WHEN density < 1.0 THEN 1.0 WHEN density < 5.0 THEN 0.6 ELSE 0.4 END)::DOUBLE AS density_factor FROM d)
    SELECT cell, zoom::INT AS zoom, density_factor, base::DOUBLE * density_factor AS budget_km, floor_km::DOUBLE AS floor_km FROM f, z""",
)
def f9_cell_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_quantity") / 1000).alias("km"))
    return maps.cell_budgets(edges, "cell", 5.0).select("cell", "zoom", "density_factor", "budget_km", "floor_km")


@query("t4_greedy_budget")
def t4_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as edges; every seventh cell has anchors and a floor."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        (2 + F.col("l_linenumber") % 6).cast("int").alias("zoom"), F.col("l_suppkey").alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_quantity").alias("km"), F.round(F.col("l_extendedprice") / 1000, 1).alias("score"),
        F.lit(150.0).alias("budget_km"), F.when(F.col("l_suppkey") % 7 == 0, 170.0).otherwise(0.0).alias("floor_km"),
    )
    return maps.greedy_budget(rows, "zoom", "cell")


RING_SQL = "stddev_pop(l_quantity) / avg(l_quantity) <= 0.56 AND count(*) FILTER (l_tax > 0.04) >= greatest(2.0, 0.05 * count(*)) AND count(l_quantity) >= 10 AND avg(l_quantity) BETWEEN 1.5 * 17 AND 1.2 * min(l_quantity + 21)"


@query("x12_ring_test", f"SELECT l_suppkey, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv, count(*) FILTER (l_tax > 0.04)::BIGINT AS votes, count(*) AS n, {RING_SQL} AS ring FROM lineitem GROUP BY 1")
def x12_ring_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("vote", (F.col("l_tax") > 0.04).cast("int"))
    found = maps.ring_test(rows, ["l_suppkey"], "l_quantity", "vote", 0.56, F.min(F.lit(17.0)), F.min(F.col("l_quantity") + 21))
    return found.select("l_suppkey", F.round("cv", 6).alias("cv"), "votes", "n", "ring")


W4_SQL = f"""
    {STATE_SQL}, e AS (SELECT state, min(population) AS lo, max(population) AS hi, min(coalesce(income, 0)) AS ilo, max(coalesce(income, 0)) AS ihi FROM counties GROUP BY 1),
    c2 AS (SELECT c_nationkey AS state, c_custkey AS county, c_custkey % 50 * 1000 AS population, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS income FROM customer),
    scaled AS (SELECT state, county, population, CASE WHEN hi > lo THEN (population - lo) / (hi - lo) ELSE 0.5 END AS np, CASE WHEN ihi > ilo THEN (income - ilo) / (ihi - ilo) ELSE 0.5 END AS ni FROM c2 JOIN e USING (state))"""


@query("w4_min_max_scale", f"WITH {W4_SQL} SELECT state, county, round(np, 9) AS norm_population, round(ni, 9) AS norm_income FROM scaled")
def w4_min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = maps.rescale(_counties(spark, sf_dir), ["population", "income"], ["state"])
    return out.select("state", "county", F.round("norm_population", 9).alias("norm_population"), F.round("norm_income", 9).alias("norm_income"))


@query(
    "w10_suitability",
    f"WITH {W4_SQL}, d AS (SELECT county, round(np::DECIMAL(18,12) * 0.4 + ni::DECIMAL(18,12) * 0.6, 4)::DOUBLE AS demand, coalesce((county % 17) * 1000.0 / nullif(population, 0), 0.0) AS per FROM scaled) SELECT county, demand, round((demand * 100 / (1 + per))::DECIMAL(18,9), 2)::DOUBLE AS suitability FROM d",
)
def w10_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counties(spark, sf_dir).withColumn("rivals", F.col("county") % 17)
    return maps.suitability(rows, {"population": 0.4, "income": 0.6}, "rivals", "population", ["state"]).select("county", "demand", "suitability")


@query(
    "x18_region_resolution",
    """
    WITH n AS (SELECT DISTINCT lower(c_mktsegment) AS name FROM customer), cat AS (SELECT DISTINCT lower(c_mktsegment) AS k, 'n' || (c_nationkey % 3) AS path FROM customer WHERE c_nationkey < 12)
    SELECT name, path, count(path) OVER (PARTITION BY name) AS candidates, count(path) OVER (PARTITION BY name) > 1 AS ambiguous FROM n LEFT JOIN cat ON k = name""",
)
def x18_region_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.routing import resolve_names

    c = table(spark, sf_dir, "customer")
    names = c.select(F.lower("c_mktsegment").alias("name")).distinct()
    catalog = c.filter("c_nationkey < 12").select(F.lower("c_mktsegment").alias("_key"), F.concat(F.lit("n"), F.col("c_nationkey") % 3).alias("path"))
    return resolve_names(names, catalog, F.col("name")).select("name", "path", "candidates", "ambiguous")


@query("x19_facilities", f"SELECT s_suppkey, CASE WHEN s_nationkey < 12 AND lon > 0 THEN -lon ELSE lon END AS lon, lat FROM (SELECT s_suppkey, s_nationkey, s_acctbal, {POINT_SQL.format(k='s_suppkey')} FROM supplier) WHERE s_acctbal > 0 AND NOT (lon = 0 AND lat = 0)")
def x19_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_nationkey", *point(F.col("s_suppkey"))).filter("not (lon = 0 and lat = 0)")
    western = (F.col("s_nationkey") < 12) & (F.col("lon") > 0)
    return s.select("s_suppkey", F.when(western, -F.col("lon")).otherwise(F.col("lon")).alias("lon"), "lat")
