"""Climate queries on the driver's tables.

Stations are suppliers, days are ship dates: tmax = quantity - 5, tmin =
quantity - 20 - 100 * tax, precipitation on returned lines only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import climate
from brindle.plans.registry import query, table

DAYS_SQL = """
    days AS (
        SELECT l_suppkey AS station, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, l_quantity - 5 AS tmax, l_quantity - 20 - 100 * l_tax AS tmin,
               CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 100 END AS prcp
        FROM lineitem
    )"""


def _mean(x: str, scale: int = 4) -> str:
    return f"sum(({x})::DECIMAL(18,{scale}))::DOUBLE / nullif(count({x}), 0)"


def _period(keys: str, empty: str) -> str:
    return f"""
        SELECT {keys}, {_mean("(tmax + tmin) / 2")} AS temp_mean, {_mean("tmin")} AS temp_min_avg, {_mean("tmax")} AS temp_max_avg,
               coalesce(sum(prcp::DECIMAL(18,4))::DOUBLE, {empty}) AS precip, count(*) FILTER (tmax > 35) AS hot_days, count(*) FILTER (tmin < 0) AS frost_days,
               count(*) FILTER (prcp > 0) AS precip_days, count(*) AS obs_days
        FROM days GROUP BY {keys}"""


YEARS_SQL = f"{DAYS_SQL}, years AS ({_period('station, year', '0.0')})"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_quantity") - 5).alias("tmax"),
        (F.col("l_quantity") - 20 - 100 * F.col("l_tax")).alias("tmin"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 100).alias("prcp"),
    )


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.period_climate(days(spark, sf_dir), ["station", "year"])


@query(
    "a1_daily_weather",
    f"""
    WITH hourly AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value AS temp, CASE WHEN event_type = 'purchase' THEN value END AS precip, user_id % 40 AS wind FROM events)
    SELECT day, min(temp) AS temp_min, max(temp) AS temp_max, {_mean("temp")} AS temp_mean, coalesce(sum(precip::DECIMAL(18,4))::DOUBLE, 0.0) AS precip, max(wind) AS wind_max, count(*) AS readings
    FROM hourly GROUP BY day""",
)
def a1_daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("temp"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("precip"), (F.col("user_id") % 40).alias("wind")
    )
    return climate.daily(hourly, ["day"])


@query(
    "a2_annual_summary",
    """
    WITH hourly AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value AS temp, CASE WHEN event_type = 'purchase' THEN value END AS precip FROM events),
    d AS (SELECT day, min(temp) AS lo, max(temp) AS hi, coalesce(sum(precip::DECIMAL(18,4)), 0) AS p FROM hourly GROUP BY day)
    SELECT left(day, 4)::INT AS year, min(lo) AS temp_min, max(hi) AS temp_max, sum(p)::DOUBLE AS precip, count(*) AS days FROM d GROUP BY 1""",
)
def a2_annual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = a1_daily_weather(spark, sf_dir)
    return by_day.groupBy(F.substring("day", 1, 4).cast("int").alias("year")).agg(
        F.min("temp_min").alias("temp_min"), F.max("temp_max").alias("temp_max"), F.sum(F.col("precip").cast("decimal(18,4)")).cast("double").alias("precip"), F.count(F.lit(1)).alias("days")
    )


@query(
    "a3_missing_percent",
    "SELECT coalesce(100.0 * count(*) FILTER (l_returnflag <> 'R') / nullif(count(*), 0), 100.0)::DOUBLE AS missing_pct FROM lineitem",
)
def a3_missing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.missing_percent(days(spark, sf_dir), "prcp")


@query("a4_yearly_climate", f"WITH {DAYS_SQL} {_period('station, year', '0.0')}")
def a4_yearly_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return years(spark, sf_dir)


@query("a5_monthly_climate", f"WITH {DAYS_SQL} {_period('station, year, month', 'NULL')}")
def a5_monthly_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.period_climate(days(spark, sf_dir), ["station", "year", "month"], empty_precip=None)


@query(
    "a6_normals",
    f"""
    WITH {DAYS_SQL}, monthly AS ({_period("station, year, month", "NULL")})
    SELECT m.month::INT AS month, {_mean("temp_mean", 8)} AS temp_normal, {_mean("precip", 8)} AS precip_normal, count(DISTINCT year) AS years
    FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN (SELECT * FROM monthly WHERE year BETWEEN 1993 AND 1996) x ON x.month = m.month GROUP BY m.month""",
)
def a6_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.normals(a5_monthly_climate(spark, sf_dir), 1993, 1996)


@query(
    "a7_anomalies",
    f"""
    WITH {YEARS_SQL}, b AS (SELECT station, {_mean("temp_mean", 8)} AS baseline FROM years WHERE year BETWEEN 1993 AND 1995 GROUP BY station)
    SELECT station, year, temp_mean, baseline, temp_mean - baseline AS anomaly FROM years LEFT JOIN b USING (station)""",
)
def a7_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.anomalies(years(spark, sf_dir), "temp_mean", 1993, 1995, ["station"]).select("station", "year", "temp_mean", "baseline", "anomaly")


@query(
    "a8_trend",
    f"""
    WITH {YEARS_SQL}
    SELECT station, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(temp_mean, year) END, 6) AS slope,
           round(CASE WHEN count(*) < 2 THEN avg(temp_mean) ELSE regr_intercept(temp_mean, year) END, 4) AS intercept, count(*) AS n
    FROM years WHERE temp_mean IS NOT NULL GROUP BY station""",
)
def a8_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = climate.trend(years(spark, sf_dir), ["station"], "year", "temp_mean")
    return fitted.select("station", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


REGION_SQL = f"""
    {YEARS_SQL}, region_years AS (
        SELECT station % 7 AS region, year, count(*) AS station_count, {_mean("temp_mean", 8)} AS temp_mean, min(temp_mean) AS temp_min_avg, max(temp_mean) AS temp_max_avg,
               coalesce({_mean("precip", 8)}, 0.0) AS precip, sum(hot_days)::BIGINT AS hot_days, sum(frost_days)::BIGINT AS frost_days, 0 AS precip_days
        FROM years GROUP BY ALL HAVING count(temp_mean) > 0
    )"""


def _region_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.region_years(years(spark, sf_dir).withColumn("region", F.col("station") % 7), ["region"])


@query("a9_region_years", f"WITH {REGION_SQL} SELECT * FROM region_years")
def a9_region_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_years(spark, sf_dir)


@query(
    "a9_decades",
    f"""
    WITH {REGION_SQL}
    SELECT region, (floor(year / 10) * 10)::INT AS decade, {_mean("temp_mean", 8)} AS avg_temp, {_mean("precip", 8)} AS avg_precip, count(*) AS years_with_data FROM region_years GROUP BY ALL""",
)
def a9_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.decades(_region_years(spark, sf_dir), ["region"])


@query(
    "a9_change_percent",
    f"""
    WITH {REGION_SQL}
    SELECT region, CASE WHEN count(*) >= 2 AND arg_min(precip, year) <> 0 THEN (arg_max(precip, year) - arg_min(precip, year)) / abs(arg_min(precip, year)) * 100 ELSE 0.0 END AS change_pct
    FROM region_years GROUP BY region""",
)
def a9_change_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.change_percent(_region_years(spark, sf_dir), ["region"], "precip")


@query(
    "a10_buoy_daily",
    f"""
    SELECT user_id % 20 AS buoy, strftime(ts, '%Y-%m-%d') AS day, {_mean("value")} AS wave_height, {_mean("CASE WHEN event_type <> 'error' THEN value END")} AS wind_direction
    FROM events GROUP BY ALL""",
)
def a10_buoy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    direction = F.when(F.col("event_type") != "error", F.col("value"))
    return e.groupBy((F.col("user_id") % 20).alias("buoy"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(climate.exact_mean(F.col("value")).alias("wave_height"), climate.exact_mean(direction).alias("wind_direction"))


@query(
    "a11_buoy_yearly",
    f"""
    WITH d AS (SELECT user_id % 20 AS buoy, strftime(ts, '%Y-%m-%d') AS day, {_mean("value")} AS wave_height FROM events GROUP BY ALL)
    SELECT buoy, left(day, 4)::INT AS year, {_mean("wave_height", 8)} AS mean_of_days, max(wave_height) AS max_day, count(*) AS days, count(*) FILTER (wave_height > 60) AS rough_days, count(*) FILTER (wave_height < 40) AS calm_days
    FROM d GROUP BY ALL""",
)
def a11_buoy_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = a10_buoy_daily(spark, sf_dir).withColumn("year", F.substring("day", 1, 4).cast("int"))
    return climate.threshold_days(by_day, ["buoy", "year"], "wave_height", {"rough_days": F.col("wave_height") > 60, "calm_days": F.col("wave_height") < 40})


@query(
    "x1_running_slope",
    f"""
    WITH {YEARS_SQL}
    SELECT station, year, temp_mean, n_years, round(CASE WHEN n_years >= 3 THEN s END, 3) AS slope
    FROM (SELECT station, year, temp_mean, count(temp_mean) OVER w AS n_years, regr_slope(temp_mean, year) OVER w * 10 AS s FROM years WHERE temp_mean IS NOT NULL
          WINDOW w AS (PARTITION BY station ORDER BY year ROWS UNBOUNDED PRECEDING))""",
)
def x1_running_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = climate.running_slope(years(spark, sf_dir), ["station"], "temp_mean", 3)
    return out.select("station", "year", "temp_mean", "n_years", F.round("slope", 3).alias("slope"))


@query(
    "x2_series_columns",
    f"""
    WITH {YEARS_SQL}
    SELECT station, string_agg(year || ':' || hot_days, ',' ORDER BY year) AS hot_days_by_year FROM years GROUP BY station""",
)
def x2_series_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = climate.series_map(years(spark, sf_dir), ["station"], "hot_days")
    return out.select("station", F.array_join(F.transform(F.map_entries("hot_days_by_year"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("hot_days_by_year"))


@query(
    "x3_region_report",
    f"""
    WITH {DAYS_SQL}, monthly AS ({_period("station, year, month", "NULL")})
    SELECT station % 7 AS region, year, month, {_mean("temp_mean", 8)} AS temp_mean, {_mean("temp_min_avg", 8)} AS temp_min_avg, {_mean("temp_max_avg", 8)} AS temp_max_avg, {_mean("precip", 8)} AS precip, count(*) AS stations
    FROM monthly GROUP BY ALL""",
)
def x3_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = a5_monthly_climate(spark, sf_dir)
    means = [climate.exact_mean(F.col(c), 8).alias(c) for c in ("temp_mean", "temp_min_avg", "temp_max_avg", "precip")]
    return monthly.groupBy((F.col("station") % 7).alias("region"), "year", "month").agg(*means, F.count(F.lit(1)).alias("stations"))


@query("p31_in_range", "SELECT coalesce(bool_and(l_quantity - 5 BETWEEN -90 AND 60), false) AS in_range FROM lineitem")
def p31_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.in_range(days(spark, sf_dir), "tmax")


@query(
    "s10_pivot_elements",
    """
    WITH long AS (
        SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, upper(event_type) AS element, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL
    )
    SELECT user_id, day, max(value) FILTER (element = 'CLICK') AS click, max(value) FILTER (element = 'VIEW') AS view, max(value) FILTER (element = 'PURCHASE') AS purchase FROM long GROUP BY ALL""",
)
def s10_pivot_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.sources.weather import pivot_elements

    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.upper("event_type").alias("element"), "value", F.col("event_id").alias("position"))
    return pivot_elements(e, ["user_id", "day"], {"CLICK": "click", "VIEW": "view", "PURCHASE": "purchase"})
