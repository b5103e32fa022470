"""Source and sink queries: data go out through a writer and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import genomics, maps, stations
from brindle.operators.lineage import shared_folder
from brindle.sources import files, weather
from brindle.plans.registry import query, table


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("s5_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s5_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("sep", "|").csv(path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double", "|")


@query("s6_json_props", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def s6_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("s7_load_result", "SELECT count(*) AS rows_written, 'ok' AS status FROM supplier UNION ALL SELECT 0, 'empty'")
def s7_load_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    results = [files.load(s, scratch(spark)), files.load(s.filter("s_suppkey < 0"), scratch(spark))]
    return spark.createDataFrame([(r["rows_written"], r["status"]) for r in results], "rows_written long, status string")


@query("s17_acs_filter", "SELECT '0500000US' || lpad(c_custkey::VARCHAR, 5, '0') AS GEOID, c_name AS NAME, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey::VARCHAR END AS B1, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS B2 FROM customer WHERE lpad(c_custkey::VARCHAR, 5, '0') LIKE '00%' AND (c_nationkey % 4 <> 0 OR c_nationkey % 3 = 0)")
def s17_acs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    c = table(spark, sf_dir, "customer")
    geoid = F.concat(F.lit("0500000US"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    rows = c.select(geoid.alias("GEOID"), F.col("c_name").alias("NAME"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("string")).alias("B1"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("B2"))
    rows.write.option("header", True).csv(path)
    return files.read_acs(spark, path, "GEOID string, NAME string, B1 string, B2 string", "00", ["B1", "B2"])


@query("s19_feature_lines", "SELECT s_suppkey AS id, s_name AS name, (s_suppkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, (s_suppkey * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat FROM supplier")
def s19_feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.plans.join_queries import suppliers

    path = scratch(spark)
    s = suppliers(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    properties = F.create_map(F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("name"), F.col("s_name"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    s.select(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")).write.json(path)
    rows = files.read_feature_lines(spark, path).withColumn("p", files.point_of(F.col("geometry")))
    return rows.select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["name"].alias("name"), "p.lon", "p.lat")


UPSERT_SQL = """
    ch AS (SELECT l_suppkey AS s_suppkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS s_acctbal FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)"""


@query("s25_upsert", f"WITH {UPSERT_SQL} SELECT s_suppkey, s_name, s.s_acctbal FROM supplier s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ch) UNION ALL SELECT s_suppkey, 'changed', s_acctbal FROM ch")
def s25_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    li = table(spark, sf_dir, "lineitem").filter("l_suppkey % 2 = 0")
    changes = li.select(F.col("l_suppkey").alias("s_suppkey"), F.lit("changed").alias("s_name"), F.col("l_quantity").alias("s_acctbal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return files.upsert(store, changes, ["s_suppkey"], "at")


@query("s28_reports", "SELECT o_custkey, max(o_orderdate) AS updated FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def s28_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated"))
    return latest.orderBy(F.desc("updated"), "o_custkey").limit(10)


@query("s29_export_columns", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey FROM customer")
def s29_export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.export_csv(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"], ["c_mktsegment"])


@query("s30_zoom_export", "SELECT 2 + l_linenumber % 6 AS zoom, count(*) AS edges FROM lineitem GROUP BY 1")
def s30_zoom_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    edges = table(spark, sf_dir, "lineitem").select((2 + F.col("l_linenumber") % 6).alias("zoom"), "l_orderkey", "l_quantity")
    # each task writes a file of each zoom that it meets: a zoom's edges need not meet in one
    edges.write.partitionBy("zoom").json(path)
    back = spark.read.schema("l_orderkey long, l_quantity double, zoom int").json(path)
    return back.groupBy("zoom").agg(F.count(F.lit(1)).alias("edges"))


@query("s31_guarded_sql", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def s31_guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("brindle_nation")
    return files.guarded_sql(spark, "SELECT n_name, n_regionkey FROM brindle_nation WHERE n_regionkey = 1")


@query("s32_cached_result", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1")
def s32_cached_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    key = files.cache_key({sf_dir: 1}, {"by": "o_orderpriority"}, "1")
    return files.cached(df, scratch(spark), key)


@query("s33_gtfs_missing", "SELECT NULL::VARCHAR AS stop_id, NULL::VARCHAR AS stop_name WHERE false")
def s33_gtfs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_gtfs(spark, scratch(spark), "stops", ["stop_id", "stop_name"])


# ---- weather, sequence and store files: written as text, read back ----------


def _written(rows: DataFrame, spark: SparkSession) -> str:
    path = scratch(spark)
    rows.write.text(path)
    return path


def _fixed(*parts: tuple) -> Column:
    """A line of (column, width) fields, right-aligned unless the width is negative."""
    return F.concat(*[F.rpad(c, -w, " ") if w < 0 else F.lpad(c, w, " ") for c, w in parts])


def _number(c: Column, digits: int) -> Column:
    return c.cast(f"decimal(12,{digits})").cast("string")


PLACE_SQL = "st AS (SELECT 'ST' || lpad(s_suppkey::VARCHAR, 9, '0') AS station_id, s_suppkey, (s_suppkey * 104729 % 160000) / 1000.0::DOUBLE - 80 AS lat, (s_suppkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon, s_nationkey / 10.0::DOUBLE AS elevation, s_name AS name FROM supplier)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ST"), F.lpad(k.cast("string"), 9, "0")).alias("station_id"), k, ((k * 104729 % 160000) / 1000.0 - 80).alias("lat"), ((k * 7919 % 360000) / 1000.0 - 180).alias("lon"), (F.col("s_nationkey") / 10.0).alias("elevation"), F.col("s_name").alias("name")
    )


@query("s8_station_catalog", f"WITH {PLACE_SQL} SELECT station_id, round(lat, 4) AS lat, round(lon, 4) AS lon, elevation, name FROM st")
def s8_station_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    line = _fixed((F.col("station_id"), -12), (_number(F.col("lat"), 4), 8), (F.lit(" "), 1), (_number(F.col("lon"), 4), 9), (F.lit(" "), 1), (_number(F.col("elevation"), 1), 6), (F.lit(""), 4), (F.col("name"), -30))
    broken = spark.range(1).select(F.lit("no station on this line, but it is long enough to be one").alias("value"))
    found = weather.read_stations(spark, _written(p.select(line.alias("value")).unionByName(broken), spark))
    return found.select("station_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "elevation", "name")


@query("s9_inventory", "SELECT 'ST' || lpad(l_suppkey::VARCHAR, 9, '0') AS station_id, min(year(l_shipdate))::INT AS first_year, max(year(l_shipdate) + l_linenumber)::INT AS last_year, array_to_string(list_sort(list(DISTINCT 'EL' || l_returnflag || l_linestatus)), ',') AS elements FROM lineitem GROUP BY 1")
def s9_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("l_shipdate")
    line = _fixed(
        (F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")), -12), (F.lit("1.0000"), 8), (F.lit(" "), 1), (F.lit("2.0000"), 9), (F.lit(" "), 1), (F.concat(F.lit("EL"), "l_returnflag", "l_linestatus"), -5),
        (year.cast("string"), 4), (F.lit(" "), 1), ((year + F.col("l_linenumber")).cast("string"), 4),
    )
    found = weather.read_inventory(spark, _written(table(spark, sf_dir, "lineitem").select(line.alias("value")), spark))
    return found.select("station_id", "first_year", "last_year", F.array_join("elements", ",").alias("elements"))


@query(
    "s11_hourly_lines",
    """
    SELECT l_orderkey % 24 AS hour, count(*) AS lines, count(*) FILTER (l_quantity <> 7) AS temps, sum(CASE WHEN l_quantity <> 7 THEN (l_quantity - 20)::DECIMAL(18,1) END)::DOUBLE AS temp_sum, count(*) FILTER (l_linenumber <> 3) AS rained,
           sum(CASE WHEN l_linenumber = 1 THEN l_linenumber WHEN l_linenumber <> 3 THEN 10 + l_linenumber END)::DOUBLE AS rain
    FROM lineitem GROUP BY 1""",
)
def s11_hourly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain is the one-hour value for line 1, missing for line 3, else the six-hour value."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    missing = F.lit("-9999")
    tenths = lambda c: (c * 10).cast("int").cast("string")
    temp, hour = F.when(q == 7, missing).otherwise(tenths(q - 20)), F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0")
    one, six = F.when(n == 1, tenths(n)).otherwise(missing), F.when((n == 1) | (n == 3), missing).otherwise(tenths(10 + n))
    line = _fixed((F.lit("2020 01 02 "), 11), (hour, 2), (temp, 6), *[(missing, 6)] * 4, (F.lit("8"), 6), (one, 6), (six, 6))
    rows = weather.read_hourly(spark, _written(table(spark, sf_dir, "lineitem").select(line.alias("value")), spark))
    total = lambda c: F.sum(F.col(c).cast("decimal(18,1)")).cast("double")
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("lines"), F.count("air_temp").alias("temps"), total("air_temp").alias("temp_sum"), F.count("precipitation").alias("rained"), total("precipitation").alias("rain"))


@query("s13_station_csv", f"WITH {PLACE_SQL} SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS usaf, name AS station_name, lat, lon, elevation FROM st")
def s13_station_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    p = _places(spark, sf_dir)
    columns = {"USAF": F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), "WBAN": F.lit("99999"), "STATION NAME": F.concat(F.col("name"), F.lit("  ")), "CTRY": F.lit("US"), "STATE": F.lit("TX"), "LAT": F.col("lat"), "LON": F.col("lon"), "ELEV(M)": F.col("elevation"), "BEGIN": F.lit("19500101"), "END": F.lit("20200101")}
    p.select(*[c.alias(n) for n, c in columns.items()]).write.option("header", True).csv(path)
    return weather.read_station_csv(spark, path).select("usaf", "station_name", "lat", "lon", "elevation")


@query("s14_buoys_xml", f"WITH {PLACE_SQL} SELECT station_id, round(lat, 3) AS lat, round(lon, 3) AS lon, s_suppkey % 2 = 0 AS met, s_suppkey % 3 = 0 AS dart FROM st")
def s14_buoys_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    flag = lambda n: F.when(F.col("s_suppkey") % n == 0, "y").otherwise("n")
    line = F.format_string('<station id="%s" lat="%s" lon="%s" name="n" owner="o" type="buoy" met="%s" currents="n" waterquality="n" dart="%s"></station>', "station_id", _number(F.col("lat"), 3), _number(F.col("lon"), 3), flag(2), flag(3))
    # a file is one document, so its lines need a root around them
    documents = p.groupBy((F.col("s_suppkey") % 4).alias("part")).agg(F.concat(F.lit("<stations>"), F.array_join(F.collect_list(line), "\n"), F.lit("</stations>")).alias("value"))
    path = scratch(spark)
    documents.write.partitionBy("part").text(path)
    return weather.read_buoys_xml(spark, path).select("station_id", "lat", "lon", "met", "dart")


@query("s15_buoy_table", "SELECT (1990 + l_orderkey % 30)::INT AS year, count(*) AS lines, sum(l_quantity::DECIMAL(18,1))::DOUBLE AS waves, count(*) FILTER (l_linenumber <> 2) AS winds FROM lineitem GROUP BY 1")
def s15_buoy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.lpad(((1990 + F.col("l_orderkey") % 30) % 100).cast("string"), 2, "0")
    line = F.concat_ws("  ", year, F.lit("01"), _number(F.col("l_quantity"), 1), F.when(F.col("l_linenumber") == 2, "MM").otherwise(F.lit("5.0")))
    body = table(spark, sf_dir, "lineitem").select(line.alias("value"))
    rows = weather.parse_table(spark.read.text(_written(body, spark)), ["YY", "MM", "WVHT", "WSPD"], ["MM"])
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("WVHT").cast("decimal(18,1)")).cast("double").alias("waves"), F.count("WSPD").alias("winds"))


@query("s16_read_quality", "SELECT count(*) AS reads, 50 * count(*) AS bases, round(sum(40 - l_linenumber)::DOUBLE / count(*), 6) AS mean_phred, (50 * count(*) // 97)::INT AS coverage_depth, sum(40 - l_linenumber)::DOUBLE / count(*) >= 30 AND 50 * count(*) // 97 >= 100 AS passed FROM lineitem")
def s16_read_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 50 bases per line item, all of one file's quality by number."""
    quality = F.repeat(F.char(F.lit(33 + 40) - F.col("l_linenumber")), 50)
    reads = table(spark, sf_dir, "lineitem").select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("l_orderkey").cast("string")), F.repeat(F.lit("A"), 50), F.lit("+"), quality).alias("value"))
    per_file = files.fastq_quality(spark, _written(reads, spark))
    total = per_file.agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), (F.sum(F.col("mean_phred") * F.col("bases")) / F.sum("bases")).alias("mean"))
    v = genomics.read_verdict(F.col("mean"), F.col("bases"), F.lit(97))
    return total.select("reads", "bases", F.round("mean", 6).alias("mean_phred"), v.alias("v")).select("reads", "bases", "mean_phred", "v.coverage_depth", "v.passed")


VARIANT_SQL = "v AS (SELECT l_orderkey, ['PR', 'RT', 'IN', 'GAG'][1 + (l_partkey % 4)::INT] AS gene, (l_suppkey % 270)::INT AS position, ['G', 'M'][1 + (l_linenumber % 2)::INT] AS ref_aa, ['A', 'V', 'E'][1 + (l_partkey % 3)::INT] AS alt_aa FROM lineitem)"


def _listed(positions: list[int]) -> str:
    return ", ".join(map(str, positions))


@query(
    "p32_mutations",
    f"""
    WITH {VARIANT_SQL}, m AS (SELECT *, CASE gene {' '.join(f"WHEN '{g}' THEN position IN ({_listed(at)})" for g, at in genomics.RESISTANCE_POSITIONS.items())} END AS drm, ref_aa = 'G' AND alt_aa IN ('A', 'R', 'E') AS apobec,
        CASE gene WHEN 'PR' THEN 'PI' WHEN 'IN' THEN 'INSTI' ELSE CASE WHEN position IN ({_listed(genomics.NRTI_POSITIONS)}) THEN 'NRTI' ELSE 'NNRTI' END END AS drug_class FROM v WHERE gene IN ('PR', 'RT', 'IN'))
    SELECT drug_class, ref_aa || position || alt_aa AS notation, count(*) AS mutations, count(*) FILTER (drm) AS drm_count, count(*) FILTER (apobec) AS apobec_count FROM m GROUP BY ALL""",
)
def p32_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values)).cast("int") + 1)
    li = table(spark, sf_dir, "lineitem")
    v = li.select(pick(["PR", "RT", "IN", "GAG"], F.col("l_partkey")).alias("gene"), (F.col("l_suppkey") % 270).cast("int").alias("position"), pick(["G", "M"], F.col("l_linenumber")).alias("ref_aa"), pick(["A", "V", "E"], F.col("l_partkey")).alias("alt_aa"))
    found = genomics.mutations(v)
    return found.groupBy("drug_class", "notation").agg(F.count(F.lit(1)).alias("mutations"), F.count_if("is_drm").alias("drm_count"), F.count_if("is_apobec").alias("apobec_count"))


@query("a37_batch_report", "SELECT o_custkey AS batch, count(*) AS samples, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderkey % 4 IN (0, 1)) AS resistant FROM orders GROUP BY 1")
def a37_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    level = F.when(k == 0, "high").when(k == 1, "low").when(k == 2, "susceptible")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), level.alias("resistance_level"))
    return genomics.batch_report(rows, "batch")


@query("s20_feature_filter", "SELECT s_suppkey AS id, (s_suppkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon FROM supplier WHERE s_nationkey < 12")
def s20_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir).withColumn("nation", (F.col("elevation") * 10).cast("int").cast("string"))
    geometry = F.struct(F.lit("Point").alias("type"), F.to_json(F.array("lon", "lat")).alias("coordinates"))
    rows = p.select(F.create_map(F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("nation"), F.col("nation")).alias("properties"), geometry.alias("geometry"))
    kept = files.write_features(rows, scratch(spark), F.col("properties")["nation"].cast("int") < 12)
    return kept.select(F.col("properties")["id"].cast("long").alias("id"), files.point_of(F.col("geometry"))["lon"].alias("lon"))


@query(
    "s27_ingest",
    """
    SELECT 'csv' AS dataset_key, c_custkey::VARCHAR AS feature_key, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS imported_at FROM customer
    UNION ALL SELECT 'json', s_suppkey::VARCHAR, s_name, 3 FROM supplier""",
)
def s27_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV, a second load that changes a third of its keys, and JSON lines."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    first, second, third = scratch(spark), scratch(spark), scratch(spark)
    c.select("c_custkey", "c_name").write.option("header", True).csv(first)
    c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("second").alias("c_name")).write.option("header", True).csv(second)
    s.select("s_suppkey", "s_name").write.json(third)
    key = F.col("properties")["c_custkey"]
    store = files.ingest(None, files.csv_records(spark, first, ["c_custkey", "c_name"]), "csv", key, "census", "csv_record", 1)
    store = files.ingest(store, files.csv_records(spark, second, ["c_custkey", "c_name"]), "csv", key, "census", "csv_record", 2)
    store = files.ingest(store, files.json_records(spark, third), "json", F.col("properties")["s_suppkey"], "census", "json_record", 3)
    return store.select("dataset_key", "feature_key", F.coalesce(F.col("properties")["c_name"], F.col("properties")["s_name"]).alias("name"), "imported_at")
