"""Data-quality, sensor and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import quality
from brindle.plans.registry import query, table


@query("p1_projection", "SELECT l_orderkey AS order_id, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 30")
def p1_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.routing import call

    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 30")
    return call(li, {"order_id": F.col("l_orderkey"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "flag": F.upper("l_returnflag")})


P5_ROWS = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS value FROM customer"


def _partial_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("value"))


@query("p5_required_errors", f"SELECT c_custkey, concat_ws(',', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN value IS NULL THEN 'value' END) AS missing FROM ({P5_ROWS}) WHERE name IS NULL OR value IS NULL")
def p5_required_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = quality.split_required(_partial_customers(spark, sf_dir), ["name", "value"])
    return errors.select("c_custkey", F.array_join("missing_fields", ",").alias("missing"))


@query("p5_required_valid", f"SELECT c_custkey, name, value FROM ({P5_ROWS}) WHERE name IS NOT NULL AND value IS NOT NULL")
def p5_required_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split_required(_partial_customers(spark, sf_dir), ["name", "value"])[0]


@query(
    "p6_rename_filter_dedup",
    """
    WITH r AS (SELECT CASE WHEN user_id % 13 = 0 THEN '' ELSE user_id::VARCHAR END AS id, event_type AS kind, event_id FROM events)
    SELECT id, arg_min(kind, event_id) AS event_kind, min(event_id) AS first_event FROM r WHERE id <> '' GROUP BY id""",
)
def p6_rename_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 13 != 0, F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.col("event_id"))
    return quality.keep_first(rows, "id", "event_id", renames={"kind": "event_kind", "event_id": "first_event"})


@query("u1_keep_first", "SELECT o_custkey::VARCHAR AS o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def u1_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


PROFILE_SQL = f"""
    profiles AS (
        SELECT 'c_custkey' AS column_name, 'bigint' AS dtype, count(*) FILTER (c_custkey IS NULL) AS missing_count, count(DISTINCT c_custkey) AS distinct_count, count(*) AS row_count FROM ({P5_ROWS})
        UNION ALL SELECT 'name', 'string', count(*) FILTER (name IS NULL), count(DISTINCT name), count(*) FROM ({P5_ROWS})
        UNION ALL SELECT 'value', 'double', count(*) FILTER (value IS NULL), count(DISTINCT value), count(*) FROM ({P5_ROWS})
    )"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(_partial_customers(spark, sf_dir))


@query("a29_profile", f"WITH {PROFILE_SQL} SELECT * FROM profiles")
def a29_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir)


@query("a30_completeness", f"WITH {PROFILE_SQL} SELECT 'completeness:' || column_name AS check_name, missing_count / greatest(row_count, 1) <= 0.1 AS passed, round(1 - missing_count / greatest(row_count, 1), 9) AS score FROM profiles")
def a30_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(_profiles(spark, sf_dir), 0.1).withColumn("score", F.round("score", 9))


@query("p23_anomalous_columns", f"WITH {PROFILE_SQL} SELECT column_name, round(missing_count / greatest(row_count, 1), 9) AS missing_rate FROM profiles WHERE missing_count / greatest(row_count, 1) > 0.1")
def p23_anomalous_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomalous(_profiles(spark, sf_dir), 0.1).withColumn("missing_rate", F.round("missing_rate", 9))


RAW_SQL = "SELECT CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS id, CASE WHEN event_id % 9 = 0 THEN 'x' || value::VARCHAR WHEN event_id % 5 <> 0 THEN value::VARCHAR END AS reading FROM events"


@query(
    "a31_accuracy",
    f"""
    WITH raw AS ({RAW_SQL}), e AS (SELECT 'id' AS c, count(*) FILTER (id IS NOT NULL AND try_cast(id AS BIGINT) IS NULL) AS n FROM raw
    UNION ALL SELECT 'reading', count(*) FILTER (reading IS NOT NULL AND try_cast(reading AS DOUBLE) IS NULL) FROM raw)
    SELECT 'accuracy:' || c AS check_name, n <= 500 AS passed, round(greatest(0.0, 1 - n / 1000.0)::DOUBLE, 9) AS score FROM e""",
)
def a31_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        F.when(k % 50 == 0, "n/a").otherwise(k.cast("string")).alias("id"),
        F.when(k % 9 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).when(k % 5 != 0, F.col("value").cast("string")).alias("reading"),
    )
    return quality.accuracy(raw, {"id": "bigint", "reading": "double"}, 500).withColumn("score", F.round("score", 9))


@query(
    "a32_weighted_score",
    f"""
    WITH {PROFILE_SQL}, s AS (SELECT avg(1 - missing_count / row_count) AS c, avg(distinct_count / row_count) AS u FROM profiles)
    SELECT round(c * 0.6 + u * 0.4, 9) AS score,
           CASE WHEN c * 0.6 + u * 0.4 >= 0.9 THEN 'A' WHEN c * 0.6 + u * 0.4 >= 0.8 THEN 'B' WHEN c * 0.6 + u * 0.4 >= 0.7 THEN 'C' WHEN c * 0.6 + u * 0.4 >= 0.6 THEN 'D' ELSE 'F' END AS grade,
           c * 0.6 + u * 0.4 >= 0.7 AS passed FROM s""",
)
def a32_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.greatest(F.col("row_count"), F.lit(1))
    s = _profiles(spark, sf_dir).agg(F.avg(1 - F.col("missing_count") / rows).alias("c"), F.avg(F.col("distinct_count") / rows).alias("u"))
    score = quality.weighted_score({"c": F.col("c"), "u": F.col("u")}, {"c": 3.0, "u": 2.0})
    return s.select(F.round(score, 9).alias("score"), quality.grade(score).alias("grade"), (score >= 0.7).alias("passed"))


@query(
    "f10_remediation",
    f"""
    WITH {PROFILE_SQL}, raw AS ({RAW_SQL}), e AS (SELECT count(*) FILTER (try_cast(id AS BIGINT) IS NULL) AS n FROM raw),
    a AS (SELECT 0 AS part, 'fill_missing' AS action, column_name AS target_column FROM profiles WHERE missing_count / row_count > 0.1
          UNION ALL SELECT 1, 'fill_missing', column_name FROM profiles WHERE missing_count / row_count > 0.05
          UNION ALL SELECT 1, 'fix_type_errors', 'id' FROM e WHERE n > 10)
    SELECT action, target_column, row_number() OVER (ORDER BY part, target_column, action)::INT AS priority FROM a""",
)
def f10_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = _profiles(spark, sf_dir)
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(F.when(k % 50 == 0, "n/a").otherwise(k.cast("string")).alias("id"))
    checks = quality.completeness(profiles, 0.05).unionByName(quality.accuracy(raw, {"id": "bigint"}, 10))
    return quality.remediation(quality.anomalous(profiles, 0.1), checks)


BREACH_SQL = """
    b AS (SELECT event_id, user_id, value,
                 CASE WHEN value <= 5 OR value >= 95 THEN 'critical' WHEN value <= 20 OR value >= 80 THEN 'warning' ELSE 'normal' END AS severity,
                 CASE WHEN value <= 5 THEN 'critical_low' WHEN value >= 95 THEN 'critical_high' WHEN value <= 20 THEN 'low' WHEN value >= 80 THEN 'high' ELSE 'none' END AS breached,
                 CASE WHEN value <= 5 THEN 5 - value WHEN value >= 95 THEN value - 95 WHEN value <= 20 THEN 20 - value WHEN value >= 80 THEN value - 80 ELSE 0 END AS deviation
          FROM events)"""


def _breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = quality.threshold_breach(F.col("value"), F.lit(20.0), F.lit(80.0), F.lit(5.0), F.lit(95.0))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", b.alias("b")).select("event_id", "user_id", "value", "b.*")


@query("p24_threshold_classify", f"WITH {BREACH_SQL} SELECT event_id, severity, breached, deviation FROM b")
def p24_threshold_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaches(spark, sf_dir).select("event_id", "severity", "breached", "deviation")


@query(
    "p25_sensor_validate",
    """
    WITH cfg AS (SELECT s_suppkey AS user_id, 1.0 + s_nationkey / 100.0 AS scale, s_acctbal / 1000 AS shift FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT event_id, value * coalesce(scale, 1.0)::DOUBLE + coalesce(shift, 0.0) AS calibrated, value * coalesce(scale, 1.0)::DOUBLE + coalesce(shift, 0.0) BETWEEN -50 AND 100 AS valid
    FROM events LEFT JOIN cfg USING (user_id)""",
)
def p25_sensor_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("user_id"), (1.0 + F.col("s_nationkey") / 100.0).alias("scale"), (F.col("s_acctbal") / 1000).alias("shift"))
    rows = table(spark, sf_dir, "events").join(cfg, "user_id", "left")
    return rows.select("event_id", F.inline(F.array(quality.calibrated(F.col("value"), F.col("scale"), F.col("shift"), F.lit(-50.0), F.lit(100.0)))))


@query("p26_alert_priority", f"WITH {BREACH_SQL} SELECT severity, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS priority, count(*) AS alerts FROM b GROUP BY 1, 2")
def p26_alert_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _breaches(spark, sf_dir).withColumn("priority", quality.alert_priority(F.col("severity")))
    return rows.groupBy("severity", "priority").agg(F.count(F.lit(1)).alias("alerts"))


@query("p27_reading_kind", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'initial' ELSE 'continuous' END AS quality FROM events")
def p27_reading_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reading_kind(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "quality")


@query(
    "a42_deploy_risk",
    """
    WITH d AS (SELECT o_orderkey, (o_orderkey % 101)::INT AS base, o_custkey AS change_size, o_orderpriority = '1-URGENT' AS prod FROM orders), r AS (SELECT *, CASE WHEN prod THEN least(100, base + 15) ELSE base END AS score FROM d)
    SELECT o_orderkey, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level, score::INT AS score,
           concat_ws(',', CASE WHEN base > 80 THEN 'large change set' END, CASE WHEN change_size > 100 THEN 'high line count' END, CASE WHEN prod THEN 'production target' END) AS factors FROM r""",
)
def a42_deploy_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.when(F.col("o_orderpriority") == "1-URGENT", "production").otherwise("staging")
    r = quality.deploy_risk((F.col("o_orderkey") % 101).cast("int"), F.col("o_custkey"), env)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.level", "r.score", F.array_join("r.factors", ",").alias("factors"))


@query(
    "a42_triage",
    """
    WITH f AS (SELECT l_orderkey, count(*) FILTER (l_discount > 0.06) + count(*) FILTER (l_tax > 0.06) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN n >= 3 THEN 'critical' WHEN n >= 1 THEN 'warning' ELSE 'info' END AS severity, n::INT AS failed, count(*) AS incidents FROM f GROUP BY 1, 2""",
)
def a42_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumn("row", F.monotonically_increasing_id())  # names the checks of one line apart
    check = lambda name, ok: F.struct(F.concat(F.lit(f"{name}-"), "row").alias("k"), F.when(ok, "pass").otherwise("fail").alias("v"))
    entries = F.flatten(F.collect_list(F.array(check("discount", F.col("l_discount") <= 0.06), check("tax", F.col("l_tax") <= 0.06))))
    checks = li.groupBy("l_orderkey").agg(F.map_from_entries(entries).alias("checks"))
    t = checks.select(quality.triage(F.col("checks")).alias("t")).select("t.severity", F.size("t.failed").alias("failed"))
    return t.groupBy("severity", "failed").agg(F.count(F.lit(1)).alias("incidents"))
