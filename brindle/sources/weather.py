"""Weather files: fixed-width, CSV and white-space tables as DataFrames.

All readers parse lines with column expressions; lines that do not parse are
left out or give null fields, as said at each reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cut(c: Column, first: int, last: int) -> Column:
    return F.trim(F.substring(c, first, last - first + 1))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width station catalog; lines without coordinates are left out."""
    line = F.col("value")
    out = spark.read.text(path).select(
        _cut(line, 1, 11).alias("station_id"), _cut(line, 13, 20).try_cast("double").alias("lat"), _cut(line, 22, 30).try_cast("double").alias("lon"),
        _cut(line, 32, 37).try_cast("double").alias("elevation"), _cut(line, 42, 71).alias("name"),
    )
    return out.filter("station_id <> '' and lat is not null and lon is not null")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width inventory as one row per station: years and elements."""
    line = F.col("value")
    rows = spark.read.text(path).select(
        _cut(line, 1, 11).alias("station_id"), _cut(line, 32, 35).alias("element"), _cut(line, 37, 40).try_cast("int").alias("first_year"), _cut(line, 42, 45).try_cast("int").alias("last_year")
    )
    rows = rows.filter("station_id <> '' and first_year is not null and last_year is not null")
    return rows.groupBy("station_id").agg(F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.sort_array(F.collect_set("element")).alias("elements"))


def pivot_elements(rows: DataFrame, keys: list[str], elements: dict[str, str]) -> DataFrame:
    """(keys, element, value, position) to one column per element; of several
    values of one element the last by position counts. Fixed columns, so one
    partial aggregation without a pass for distinct values."""
    named = [F.max_by("value", F.when(F.col("element") == code, F.col("position"))).alias(name) for code, name in elements.items()]
    return rows.filter(F.col("element").isin(*elements)).groupBy(*keys).agg(*named)


def read_daily_csv(spark: SparkSession, path: str, first_year: int, last_year: int, skip_flagged: bool = True) -> DataFrame:
    """Long daily CSV (id, date, element, value in tenths, flags) to wide rows;
    flagged values are null if ``skip_flagged``."""
    schema = "id string, date string, element string, value string, m_flag string, q_flag string, s_flag string, obs_time string"
    rows = spark.read.schema(schema).csv(path).withColumn("position", F.monotonically_increasing_id())
    rows = rows.filter(F.substring("date", 1, 4).try_cast("int").between(first_year, last_year))
    flagged = (F.coalesce("q_flag", F.lit("")) != "") if skip_flagged else F.lit(False)
    value = F.when(~flagged, F.col("value").try_cast("double") / 10)
    rows = rows.select(F.col("id").alias("station_id"), "date", "element", value.alias("value"), "position")
    return pivot_elements(rows, ["station_id", "date"], {"TMAX": "tmax", "TMIN": "tmin", "PRCP": "prcp", "SNOW": "snow", "SNWD": "snwd"})


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width hourly lines, plain or gzip; -9999 is null, tenths are scaled,
    precipitation is the one-hour value or else the six-hour value."""
    line = F.col("value")

    def number(first: int, last: int, scale: float = 1.0) -> Column:
        raw = F.nullif(_cut(line, first, last).try_cast("int"), F.lit(-9999))
        return raw / scale if scale != 1.0 else raw

    rows = spark.read.text(path).filter(F.length("value") >= 43)
    out = rows.select(
        F.concat_ws("-", _cut(line, 1, 4), _cut(line, 6, 7), _cut(line, 9, 10)).alias("date"), _cut(line, 12, 13).try_cast("int").alias("hour"),
        number(14, 19, 10.0).alias("air_temp"), number(20, 25, 10.0).alias("dew_point"), number(26, 31, 10.0).alias("sea_level_pressure"), number(32, 37).alias("wind_direction"),
        number(38, 43, 10.0).alias("wind_speed"), number(44, 49).alias("sky_condition"), F.coalesce(number(50, 55, 10.0), number(56, 61, 10.0)).alias("precipitation"),
    )
    return out.filter("hour is not null")


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("USAF").alias("usaf"), F.col("WBAN").alias("wban"), F.trim("STATION NAME").alias("station_name"), F.col("CTRY").alias("country"), F.col("STATE").alias("state"),
        F.col("LAT").try_cast("double").alias("lat"), F.col("LON").try_cast("double").alias("lon"), F.col("`ELEV(M)`").try_cast("double").alias("elevation"), F.col("BEGIN").alias("begin_date"), F.col("END").alias("end_date"),
    )


def read_buoys_xml(spark: SparkSession, path: str) -> DataFrame:
    """Active buoy stations; y/n attributes become booleans. Each file is one
    XML document with a root of its own."""
    schema = "_id string, _lat string, _lon string, _name string, _owner string, _type string, _met string, _currents string, _waterquality string, _dart string"
    raw = spark.read.format("xml").option("rowTag", "station").schema(schema).load(path)
    flags = [(F.lower(F.coalesce(f"_{f}", F.lit("n"))) == "y").alias(f) for f in ("met", "currents", "waterquality", "dart")]
    return raw.select(
        F.col("_id").alias("station_id"), F.col("_name").alias("name"), F.col("_type").alias("type"), F.col("_owner").alias("owner"), F.col("_lat").try_cast("double").alias("lat"), F.col("_lon").try_cast("double").alias("lon"), *flags
    )


def parse_table(lines: DataFrame, header: list[str], missing: list[str]) -> DataFrame:
    """White-space separated lines (``value``) under a known header; lines that
    begin with # are left out, missing tokens are null, two-digit years from
    50 on are of the 1900s."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("_p"))
    cell = lambda i: F.try_element_at("_p", F.lit(i + 1))
    value = lambda i: F.when(~F.coalesce(cell(i).isin(*missing), F.lit(True)), cell(i).try_cast("double"))
    out = rows.select(*[value(i).alias(name) for i, name in enumerate(header)])
    if header[0] in ("YY", "YYYY", "#YY"):
        y = F.col(f"`{header[0]}`").cast("int")
        out = out.withColumn("year", F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y))
    return out


def read_table(spark: SparkSession, path: str, missing: tuple[str, ...] = ("MM", "99.0", "999", "999.0", "9999.0", "99.00")) -> DataFrame:
    """A table whose first line is its header, with or without a leading #."""
    lines = spark.read.text(path)
    header = lines.first()["value"].lstrip("#").split()
    body = lines.filter(~F.ltrim(F.regexp_replace("value", "^#", "")).startswith(" ".join(header[:1])))
    return parse_table(body, header, list(missing))
