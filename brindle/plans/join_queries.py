"""Join queries. Tables have no coordinates, so points follow from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.geo import drive_estimate, haversine
from brindle.operators import joins, stations
from brindle.plans.registry import query, table

POINT_SQL = "({k} * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, ({k} * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat"


def haversine_sql(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def point(key: Column) -> list[Column]:
    k = key.cast("long")
    return [((k * 7919 % 36000) / 100.0 - 180).alias("lon"), ((k * 104729 % 16000) / 100.0 - 80).alias("lat")]


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *point(F.col("c_custkey")))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", *point(F.col("s_suppkey")))


@query("j1_step_reference", "SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j1_step_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(done, "l_orderkey")


@query(
    "j2_overwrite_join",
    """
    WITH o AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, CASE WHEN o.o_custkey IS NOT NULL THEN o.c_acctbal ELSE c.c_acctbal END AS c_acctbal, priority FROM customer c LEFT JOIN o ON c_custkey = o_custkey""",
)
def j2_overwrite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return joins.overwrite_join(c, o, "c_custkey", "o_orderkey").select("c_custkey", "c_name", "c_acctbal", "priority")


@query(
    "j3_merge_tables",
    """
    WITH a AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region FROM nation),
    b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name FROM supplier),
    c AS (SELECT p_partkey AS id, p_brand AS brand FROM part)
    SELECT id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, region, brand FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)""",
)
def j3_merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return joins.merge_tables([a, b, c], "id")


@query(
    "j4_fallback_join",
    """
    WITH l AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 5, '0') AS geoid FROM customer),
    r AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN '0500000US' ELSE '' END || lpad(o_custkey::VARCHAR, 5, '0') AS id, count(*) AS orders FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey)
    SELECT c_custkey, geoid, coalesce(f.orders, w.orders) AS orders FROM l LEFT JOIN r f ON f.id = '0500000US' || geoid LEFT JOIN r w ON w.id = geoid""",
)
def j4_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("geoid"))
    o = table(spark, sf_dir, "orders").filter("o_custkey % 5 <> 0").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    right = o.select(F.concat(F.when(F.col("o_custkey") % 2 == 0, "0500000US").otherwise(""), F.lpad(F.col("o_custkey").cast("string"), 5, "0")).alias("id"), "orders")
    return joins.fallback_join(left, right, "geoid", F.concat(F.lit("0500000US"), F.col("geoid")), "id").select("c_custkey", "geoid", "orders")


SQUARES_SQL = f"""
    squares AS (
        SELECT s_suppkey, lon - 4 AS w, lon + 5 AS e, lat - 3 AS s, lat + 4 AS n FROM (SELECT s_suppkey, {POINT_SQL.format(k="s_suppkey")} FROM supplier)
    ), c AS (SELECT c_custkey, {POINT_SQL.format(k="c_custkey")} FROM customer)"""


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    corner = lambda x, y: F.struct((F.col("lon") + x).cast("double").alias("lon"), (F.col("lat") + y).cast("double").alias("lat"))
    return s.select("s_suppkey", F.array(corner(-4, -3), corner(5, -3), corner(5, 4), corner(-4, 4)).alias("ring"))


@query(
    "j5_point_in_polygon",
    f"""
    WITH {SQUARES_SQL}, hit AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM c JOIN squares ON lon >= w AND lon < e AND lat >= s AND lat < n GROUP BY c_custkey)
    SELECT s_suppkey, count(*) AS customers FROM hit GROUP BY s_suppkey""",
)
def j5_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = joins.first_containing(customers(spark, sf_dir), _squares(spark, sf_dir), "c_custkey", "s_suppkey", cell=10.0)
    return hit.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("customers"))


NEAREST_SQL = f"""
    c AS (SELECT c_custkey, {POINT_SQL.format(k="c_custkey")} FROM customer), s AS (SELECT s_suppkey, {POINT_SQL.format(k="s_suppkey")} FROM supplier),
    near AS (SELECT c_custkey, s_suppkey, {haversine_sql("c", "s")} AS metres FROM c, s),
    best AS (SELECT c_custkey, arg_min(s_suppkey, (round(metres, 3), s_suppkey)) AS s_suppkey, min(metres) AS metres FROM near WHERE metres <= 500000 GROUP BY c_custkey)"""


@query(
    "j6_nearest_left",
    f"WITH {NEAREST_SQL} SELECT c.c_custkey, best.s_suppkey, round(coalesce(metres, -1), 3) AS metres FROM c LEFT JOIN best USING (c_custkey)",
)
def j6_nearest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.nearest(customers(spark, sf_dir).select("c_custkey", "lon", "lat"), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 500_000.0)
    return out.select("c_custkey", "s_suppkey", F.round("metres", 3).alias("metres"))


@query("j7_nearest_inner", f"WITH {NEAREST_SQL} SELECT c_custkey, s_suppkey, round(metres, 3) AS metres FROM best JOIN supplier USING (s_suppkey) WHERE s_acctbal > 0")
def j7_nearest_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = joins.nearest(customers(spark, sf_dir).select("c_custkey", "lon", "lat"), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 500_000.0, how="inner")
    # a nearest station without a value drops the row
    valued = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    return near.join(valued, "s_suppkey").select("c_custkey", "s_suppkey", F.round("metres", 3).alias("metres"))


@query(
    "j8_walk_bands",
    f"""
    WITH {NEAREST_SQL}
    SELECT CASE WHEN metres <= 100000 THEN 'near' WHEN metres <= 300000 THEN 'medium' WHEN metres IS NOT NULL THEN 'far' ELSE 'none' END AS band, count(*) AS customers
    FROM c LEFT JOIN best USING (c_custkey) GROUP BY 1""",
)
def j8_walk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.nearest(customers(spark, sf_dir).select("c_custkey", "lon", "lat"), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 500_000.0)
    m = F.col("metres")
    band = F.when(m < 0, "none").when(m <= 100_000, "near").when(m <= 300_000, "medium").otherwise("far")
    return out.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("customers"))


@query(
    "j9_active_service",
    """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE o_orderpriority END AS service FROM orders)
    SELECT o_orderkey, service FROM t WHERE service = '' OR service IN ('1-URGENT', '2-HIGH')""",
)
def j9_active_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("service"))
    active = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "service string")
    return joins.in_active_service(trips, active, "service")


CELLS_SQL = f"""
    c AS (SELECT DISTINCT floor(lon / 5)::BIGINT AS x, floor(lat / 5)::BIGINT AS y FROM (SELECT {POINT_SQL.format(k="c_custkey")} FROM customer)),
    s AS (SELECT DISTINCT floor(lon / 5)::BIGINT AS x, floor(lat / 5)::BIGINT AS y FROM (SELECT {POINT_SQL.format(k="s_suppkey")} FROM supplier))"""


def _cells(df: DataFrame) -> DataFrame:
    return df.select(F.floor(F.col("lon") / 5).cast("long").alias("x"), F.floor(F.col("lat") / 5).cast("long").alias("y")).distinct()


@query("j10_coverage_gaps", f"WITH {CELLS_SQL} SELECT x, y, NOT EXISTS (SELECT 1 FROM s WHERE s.x = c.x AND s.y = c.y) AS gap FROM c")
def j10_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, served = _cells(customers(spark, sf_dir)), _cells(suppliers(spark, sf_dir))
    gaps = wanted.join(served, ["x", "y"], "left_anti").withColumn("gap", F.lit(True))
    return gaps.unionByName(wanted.join(served, ["x", "y"], "left_semi").withColumn("gap", F.lit(False)))


@query("u3_cell_sets", f"WITH {CELLS_SQL} SELECT 'both' AS kind, count(*) AS cells FROM (SELECT * FROM c INTERSECT SELECT * FROM s) UNION ALL SELECT 'only_first', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM s)")
def u3_cell_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _cells(customers(spark, sf_dir)), _cells(suppliers(spark, sf_dir))
    tagged = a.intersect(b).select(F.lit("both").alias("kind")).unionByName(a.subtract(b).select(F.lit("only_first").alias("kind")))
    counts = tagged.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"))
    kinds = spark.createDataFrame([("both",), ("only_first",)], "kind string")
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("cells", F.lit(0)).alias("cells"))


@query("a26_coverage", f"WITH {CELLS_SQL} SELECT round(100.0 * (SELECT count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM s)) / (SELECT count(*) FROM c), 4)::DOUBLE AS coverage_pct")
def a26_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = j10_coverage_gaps(spark, sf_dir)
    return marked.agg(F.round(100.0 * F.count_if(~F.col("gap")) / F.count(F.lit(1)), 4).alias("coverage_pct"))


@query(
    "j11_dangling_references",
    """
    SELECT l_orderkey, count(*) AS missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) GROUP BY l_orderkey""",
)
def j11_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    known = table(spark, sf_dir, "part").filter("p_size > 5")
    return joins.dangling(refs, "l_orderkey", "l_partkey", known, "p_partkey")


@query(
    "j12_first_shape",
    """
    SELECT o_custkey, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_shipdate, l_partkey)) AS first_shipdate, arg_min(l_partkey, (l_orderkey, l_linenumber, l_shipdate, l_partkey)) AS first_part FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
)
def j12_first_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_partkey")
    at = F.struct("o_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return o.join(li, "o_orderkey").groupBy("o_custkey").agg(F.min_by("l_shipdate", at).alias("first_shipdate"), F.min_by("l_partkey", at).alias("first_part"))


@query(
    "p7_station_filter",
    f"""
    WITH st AS (SELECT s_suppkey, s_nationkey, {POINT_SQL.format(k="s_suppkey")} FROM supplier),
    inv AS (SELECT l_suppkey, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year, list_sort(list(DISTINCT l_returnflag)) AS elements FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, first_year::INT AS first_year, last_year::INT AS last_year FROM st JOIN inv ON l_suppkey = s_suppkey
    WHERE s_nationkey < 20 AND lon BETWEEN -150 AND 150 AND lat BETWEEN -60 AND 60 AND list_has_all(elements, ['A', 'R']) AND first_year <= 1995 AND last_year >= 1996
    ORDER BY last_year - first_year DESC, s_suppkey LIMIT 20""",
)
def p7_station_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    inventory = li.groupBy("l_suppkey").agg(F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"), F.collect_set("l_returnflag").alias("elements"))
    st = suppliers(spark, sf_dir).filter("s_nationkey < 20 and lon between -150 and 150 and lat between -60 and 60")
    found = st.join(inventory, st["s_suppkey"] == inventory["l_suppkey"]).filter((F.size(F.array_except(F.array(F.lit("A"), F.lit("R")), "elements")) == 0) & (F.col("first_year") <= 1995) & (F.col("last_year") >= 1996))
    return found.orderBy(F.desc(F.col("last_year") - F.col("first_year")), "s_suppkey").limit(20).select("s_suppkey", "first_year", "last_year")


PAIRS_SQL = f"""
    a AS (SELECT s_suppkey, s_nationkey, {POINT_SQL.format(k="s_suppkey")} FROM supplier),
    pairs AS (SELECT p.s_nationkey, p.s_suppkey AS a, q.s_suppkey AS b, {haversine_sql("p", "q")} AS metres FROM a p JOIN a q ON p.s_nationkey = q.s_nationkey AND p.s_suppkey < q.s_suppkey)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.unordered_pairs(suppliers(spark, sf_dir), "s_nationkey", "s_suppkey")
    return p.withColumn("metres", haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")))


@query("j14_anchor_pairs", f"WITH {PAIRS_SQL} SELECT s_nationkey, a, b, round(metres, 2) AS metres FROM pairs WHERE metres >= 2000000")
def j14_anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = _pairs(spark, sf_dir).filter("metres >= 2000000")
    return far.select("s_nationkey", F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.round("metres", 2).alias("metres"))


@query("j14_sampled_pairs", f"WITH {PAIRS_SQL} SELECT s_nationkey, a, b FROM pairs WHERE metres >= 150000 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(a || '-' || b)) <= 3")
def j14_sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is the feature: three pairs of each nation in hashed order."""
    pairs = joins.sampled_pairs(suppliers(spark, sf_dir), "s_nationkey", "s_suppkey", 150_000.0, 3)
    return pairs.select("s_nationkey", F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


SNAP_SQL = """
    p AS (SELECT c_custkey, 8 + c_custkey % 400 / 4000.0::DOUBLE AS lon, 47 + c_custkey % 77 / 7700.0::DOUBLE AS lat FROM customer),
    s AS (SELECT p_partkey AS edge, 8 + p_partkey % 40 / 400.0::DOUBLE AS x1, 47 + p_partkey % 11 / 1100.0::DOUBLE AS y1, 8 + (p_partkey % 40 + 3) / 400.0::DOUBLE AS x2, 47 + (p_partkey % 11 + 1 + p_partkey % 3) / 1100.0::DOUBLE AS y2 FROM part WHERE p_partkey % 2 = 0),
    t AS (SELECT *, cos(radians(lat)) AS k, (x2 - x1) * cos(radians(lat)) AS dx, y2 - y1 AS dy FROM p, s),
    u AS (SELECT *, least(greatest(((lon - x1) * k * dx + (lat - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0) AS f FROM t),
    v AS (SELECT c_custkey, edge, 2 * 6371000 * asin(sqrt(power(sin(radians(y1 + f * (y2 - y1) - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y1 + f * (y2 - y1))) * power(sin(radians(x1 + f * (x2 - x1) - lon) / 2), 2))) AS metres FROM u)"""


@query("x13_snap", f"WITH {SNAP_SQL} SELECT c_custkey, round(min(metres), 2) AS metres FROM v WHERE metres < 50 GROUP BY c_custkey")
def x13_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("c_custkey"), F.col("p_partkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (8 + k % 400 / 4000.0).alias("lon"), (47 + k % 77 / 7700.0).alias("lat"))
    ends = [(8 + e % 40 / 400.0).alias("x1"), (47 + e % 11 / 1100.0).alias("y1"), (8 + (e % 40 + 3) / 400.0).alias("x2"), (47 + (e % 11 + 1 + e % 3) / 1100.0).alias("y2")]
    edges = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(e.alias("edge"), *ends)
    return joins.snap(points, edges, "c_custkey", "edge").select("c_custkey", F.round("metres", 2).alias("metres"))


@query("x14_convex_hull")
def x14_convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of the places of each order status's orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", *point(F.col("o_orderkey")))
    return joins.convex_hull(rows, "o_orderstatus")


STATE_POINT_SQL = "p AS (SELECT c_custkey, -125 + (c_custkey * 7919 % 5800) / 100.0::DOUBLE AS lon, 25 + (c_custkey * 104729 % 2500) / 100.0::DOUBLE AS lat FROM customer)"
BOXES_SQL = ", ".join(f"('{s}', {a}, {b}, {c}, {d})" for s, (a, b, c, d) in stations.STATE_BOXES.items())


def _state_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (-125 + (k * 7919 % 5800) / 100.0).alias("lon"), (25 + (k * 104729 % 2500) / 100.0).alias("lat"))


@query("p8_states", f"WITH {STATE_POINT_SQL}, b(state, a, c, d, e) AS (VALUES {BOXES_SQL}) SELECT state, count(*) AS places, count(*) FILTER (state = 'TX') AS texan FROM p JOIN b ON lat BETWEEN a AND c AND lon BETWEEN d AND e GROUP BY state")
def p8_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _state_points(spark, sf_dir)
    rows = p.select(F.explode(stations.states_of(F.col("lat"), F.col("lon"))).alias("state"), stations.in_state(F.col("lat"), F.col("lon"), F.lit("tx")).alias("tx"))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("tx") & (F.col("state") == "TX")).alias("texan"))


@query("p9_active_stations", f"WITH {STATE_POINT_SQL} SELECT c_custkey FROM p JOIN customer USING (c_custkey) WHERE c_nationkey = 7 AND c_custkey % 10 <> 0 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10")
def p9_active_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("country", F.when(F.col("c_nationkey") == 7, "US").otherwise("XX")).withColumnRenamed("c_mktsegment", "state")
    rows = c.join(_state_points(spark, sf_dir), "c_custkey").withColumns({n: F.when(F.col("c_custkey") % 10 == 0, 0.0).otherwise(F.col(n)) for n in ("lat", "lon")})
    return stations.active_stations(rows, "c_custkey", "US", "BUILDING", 10).select("c_custkey")


@query("p10_buoys", f"WITH {STATE_POINT_SQL} SELECT c_custkey AS station_id FROM p JOIN customer USING (c_custkey) WHERE lat BETWEEN 30 AND 45 AND lon BETWEEN -120 AND -80 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 2 = 0 AND c_custkey % 3 = 0 ORDER BY 1 LIMIT 25")
def p10_buoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(_state_points(spark, sf_dir), "c_custkey")
    rows = c.select(F.col("c_custkey").alias("station_id"), "lat", "lon", F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 2 == 0).alias("met"), (F.col("c_custkey") % 3 == 0).alias("dart"))
    return stations.buoys(rows, (30.0, 45.0, -120.0, -80.0), {"BUILDING", "MACHINERY"}, ("met", "dart"), 25).select("station_id")


@query("x8_route_totals", f"WITH {PAIRS_SQL} SELECT s_nationkey, count(*) AS pairs, round(sum(metres) / 1000 * 1.3, 3) AS km, round(sum(metres) / 1000 * 1.3 / 80 * 60, 2) AS minutes FROM pairs GROUP BY s_nationkey")
def x8_route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = drive_estimate(F.col("metres"))
    rows = _pairs(spark, sf_dir).withColumn("e", est)
    return rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("e.km"), 3).alias("km"), F.round(F.sum("e.minutes"), 2).alias("minutes"))


@query(
    "x9_route_estimate",
    f"""
    WITH {PAIRS_SQL} SELECT a, b, round(metres / 1000 * 1.3, 3) AS km, round(metres / 1000 * 1.3 / 80 * 60, 2) AS minutes FROM pairs""",
)
def x9_route_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), drive_estimate(F.col("metres")).alias("e"))
    return rows.select("a", "b", F.round("e.km", 3).alias("km"), F.round("e.minutes", 2).alias("minutes"))


@query(
    "x4_latest_per_group",
    "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey",
)
def x4_latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.fleet import latest

    return latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "x5_lateral_counts",
    """
    SELECT c_custkey, coalesce(n.orders, 0) AS orders, coalesce(n.urgent, 0) AS urgent FROM customer
    LEFT JOIN LATERAL (SELECT count(*) AS orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders WHERE o_custkey = c_custkey) n ON true""",
)
def x5_lateral_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["orders", "urgent"])


@query("j17_parameter_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 5.0 END * value AS weighted FROM events")
def j17_parameter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for pair in {"click": 1.0, "view": 0.5, "purchase": 5.0}.items() for x in pair])
    return table(spark, sf_dir, "events").select("event_id", (F.try_element_at(weights, F.col("event_type")) * F.col("value")).alias("weighted"))
