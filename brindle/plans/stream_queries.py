"""Streaming queries: the events table is read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.registry import query, table
from brindle.plans.source_queries import scratch
from brindle.streaming import monitor


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return monitor.drain_to(stream, scratch(spark), scratch(spark))


@query(
    "st9_sensor_alerts",
    """
    SELECT event_id, CASE WHEN value <= 5 OR value >= 95 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN value <= 5 OR value >= 95 THEN 1 ELSE 2 END AS priority
    FROM events WHERE value <= 20 OR value >= 80""",
)
def st9_sensor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(monitor.alerts(_stream(spark, sf_dir), (20, 80, 5, 95)).select("event_id", "severity", "priority"))


@query("st1_windowed_counts", "SELECT epoch_ms(date_trunc('hour', ts)) AS window_start_ms, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def st1_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.drain_complete(monitor.windowed_counts(_stream(spark, sf_dir), "event_type", "1 hour"), scratch(spark), scratch(spark))
    return out.select(F.unix_millis("window_start").alias("window_start_ms"), "event_type", "n", "total")


@query(
    "st8_sessions",
    """
    WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true)::INT AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, nr""",
)
def st8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.drain_complete(monitor.sessions(_stream(spark, sf_dir), "user_id", "30 minutes"), scratch(spark), scratch(spark))
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("st7_breaker_states")
def st7_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of every user's circuit over all events."""
    results = _stream(spark, sf_dir).select(F.col("user_id").alias("handler"), F.unix_millis("ts").alias("at_ms"), (F.col("value") > 30).alias("failed"))
    return _drained(monitor.breaker_stream(results))
