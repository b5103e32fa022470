"""Weather and climate summaries over station time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import exact_mean, exact_sum

HOT, FROST = 35.0, 0.0


def daily(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """Per day: extremes and mean of ``temp``, sum of ``precip`` (0 if there is
    none), highest ``wind``, number of readings."""
    return hourly.groupBy(*keys).agg(
        F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), exact_mean(F.col("temp")).alias("temp_mean"),
        F.coalesce(exact_sum(F.col("precip")), F.lit(0.0)).alias("precip"), F.max("wind").alias("wind_max"), F.count(F.lit(1)).alias("readings"),
    )


def missing_percent(df: DataFrame, column: str) -> DataFrame:
    """Share of null values in percent; an empty input is all missing."""
    return df.agg(F.coalesce(100.0 * F.count_if(F.col(column).isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(100.0)).alias("missing_pct"))


def in_range(df: DataFrame, column: str, low: float = -90.0, high: float = 60.0) -> DataFrame:
    """Whether all non-null values lie in the range; false if there are none."""
    return df.agg(F.coalesce(F.bool_and(F.col(column).between(low, high)), F.lit(False)).alias("in_range"))


def period_climate(days: DataFrame, keys: list[str], empty_precip: float | None = 0.0) -> DataFrame:
    """Climate of each period from daily ``tmax``, ``tmin``, ``prcp``.

    The mean is that of (tmax + tmin) / 2 over days that have both; hot days
    exceed 35, frost days lie below 0, wet days above 0. Without any
    precipitation value the total is ``empty_precip`` (0 by year, null by month).
    """
    mid = (F.col("tmax") + F.col("tmin")) / 2
    total = exact_sum(F.col("prcp"))
    return days.groupBy(*keys).agg(
        exact_mean(mid).alias("temp_mean"), exact_mean(F.col("tmin")).alias("temp_min_avg"), exact_mean(F.col("tmax")).alias("temp_max_avg"),
        (total if empty_precip is None else F.coalesce(total, F.lit(empty_precip))).alias("precip"),
        F.count_if(F.col("tmax") > HOT).alias("hot_days"), F.count_if(F.col("tmin") < FROST).alias("frost_days"), F.count_if(F.col("prcp") > 0).alias("precip_days"),
        F.count(F.lit(1)).alias("obs_days"),
    )


def normals(monthly: DataFrame, first: int, last: int) -> DataFrame:
    """Means by month over the years first to last; all twelve months are there."""
    months = monthly.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    inside = monthly.filter(F.col("year").between(first, last))
    means = inside.groupBy("month").agg(exact_mean(F.col("temp_mean"), 8).alias("temp_normal"), exact_mean(F.col("precip"), 8).alias("precip_normal"), F.count_distinct("year").alias("years"))
    return months.join(means, "month", "left").withColumn("years", F.coalesce("years", F.lit(0)))


def anomalies(yearly: DataFrame, column: str, first: int, last: int, keys: list[str]) -> DataFrame:
    """Each year's value less the mean of the baseline years of its series."""
    base = F.when(F.col("year").between(first, last), F.col(column))
    series = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(base.cast("decimal(18,8)")).over(series).cast("double"), F.count(base).over(series))
    return yearly.withColumn("baseline", mean).withColumn("anomaly", F.col(column) - F.col("baseline"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group over rows with both values: (0, 0) for no
    row, (0, y) for one, (0, mean) if x does not vary."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fitted = both.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("n"))
    flat = F.col("slope").isNull() | F.isnan("slope")
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    joined = groups.join(fitted, keys, "left") if keys else groups.crossJoin(fitted)
    return joined.select(
        *keys, F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(flat, F.coalesce("_mean", F.lit(0.0))).otherwise(F.col("intercept")).alias("intercept"), F.coalesce("n", F.lit(0)).alias("n")
    )


def region_years(yearly: DataFrame, keys: list[str]) -> DataFrame:
    """Stations of a region by year. The extremes are those of the stations'
    means; years without a temperature are left out; hot and frost days add up
    over stations, wet days are not carried."""
    return (
        yearly.groupBy(*keys, "year")
        .agg(
            F.count(F.lit(1)).alias("station_count"), exact_mean(F.col("temp_mean"), 8).alias("temp_mean"), F.min("temp_mean").alias("temp_min_avg"), F.max("temp_mean").alias("temp_max_avg"),
            F.coalesce(exact_mean(F.col("precip"), 8), F.lit(0.0)).alias("precip"), F.sum("hot_days").alias("hot_days"), F.sum("frost_days").alias("frost_days"),
        )
        .filter("temp_mean is not null")
        .withColumn("precip_days", F.lit(0))
    )


def decades(years: DataFrame, keys: list[str]) -> DataFrame:
    return years.groupBy(*keys, (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(
        exact_mean(F.col("temp_mean"), 8).alias("avg_temp"), exact_mean(F.col("precip"), 8).alias("avg_precip"), F.count(F.lit(1)).alias("years_with_data")
    )


def change_percent(years: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Change from the first to the last year in percent of the first; 0 with
    fewer than two years or a first value of zero."""
    first, last = F.min_by(column, "year"), F.max_by(column, "year")
    ok = (F.count(F.lit(1)) >= 2) & (first != 0)
    return years.groupBy(*keys).agg(F.when(ok, (last - first) / F.abs(first) * 100).otherwise(0.0).alias("change_pct"))


def running_slope(years: DataFrame, keys: list[str], column: str, least: int, scale: float = 10.0) -> DataFrame:
    """Slope per decade over the years so far; null before ``least`` of them.
    Years without a value neither count nor get a slope of their own."""
    so_far = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = years.filter(F.col(column).isNotNull())
    slope = F.regr_slope(F.col(column), F.col("year").cast("double")).over(so_far) * scale
    return valued.withColumn("n_years", F.count(column).over(so_far)).withColumn("slope", F.when(F.col("n_years") >= least, slope))


def series_map(years: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A series as map<year, value> instead of data-dependent columns."""
    return years.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", column)))).alias(f"{column}_by_year"))


def threshold_days(daily_means: DataFrame, keys: list[str], column: str, limits: dict[str, Column]) -> DataFrame:
    """Mean of daily means, highest day and number of days in each condition."""
    return daily_means.groupBy(*keys).agg(
        exact_mean(F.col(column), 8).alias("mean_of_days"), F.max(column).alias("max_day"), F.count(F.lit(1)).alias("days"), *[F.count_if(c).alias(name) for name, c in limits.items()]
    )
