"""Portfolio risk over simulated or historic profit and loss."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tail_risk(df: DataFrame, keys: list[str], value: str, confidence: float, tag: str = "") -> DataFrame:
    """Value at risk: the value at place int((1 - c) n) in ascending order, no
    interpolation; and the mean of all values up to it, ties included.

    Values are ranked by counts of distinct values, so equal values shuffle as
    one row and a group's sort holds distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(group))
    place = F.least(F.floor(F.lit(1 - confidence) * F.col("_all") + 1e-9).cast("long"), F.col("_all") - 1)
    tail = ranked.filter(F.col("_upto") - F.col("_n") <= place)  # values up to the one at that place
    total = F.sum(F.col(value).cast("decimal(18,4)") * F.col("_n")).cast("double")
    return tail.groupBy(*keys).agg(F.max(value).alias(f"var{tag}"), (total / F.sum("_n")).alias(f"cvar{tag}"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """VaR and CVaR at 95 and 99 percent, largest drawdown |min|, sample
    standard deviation and mean over deviation (0 if that is 0 or unknown)."""
    mean = F.sum(F.col(value).cast("decimal(18,4)")).cast("double") / F.count(value)
    base = df.groupBy(*keys).agg(F.abs(F.min(value)).alias("max_drawdown"), F.stddev_samp(value).alias("std"), mean.alias("mean"), F.count(value).alias("n"))
    base = base.withColumn("sharpe", F.when(F.coalesce("std", F.lit(0.0)) > 0, F.col("mean") / F.col("std")).otherwise(0.0))
    for c in (95, 99):
        base = base.join(tail_risk(df, keys, value, c / 100, str(c)), keys, "left")
    return base


def stress(positions: DataFrame, scenarios: DataFrame, portfolio: str) -> DataFrame:
    """Loss of each portfolio in each scenario (asset -> shock; a missing shock
    is 0), and the positions it hurts and helps most (first wins ties)."""
    asset = positions.join(scenarios, "asset", "left")  # one row per position and scenario that names its asset
    hit = asset.withColumn("effect", F.col("value") * F.coalesce("shock", F.lit(0.0)))
    return hit.filter("scenario is not null").groupBy(portfolio, "scenario").agg(
        F.sum(F.col("effect").cast("decimal(18,4)")).cast("double").alias("pnl"), F.min_by("asset", F.struct("effect", "asset")).alias("worst_asset"),
        F.min_by("asset", F.struct(-F.col("effect"), F.col("asset"))).alias("best_asset"),
    )


def cholesky(matrix: list[list[float]]) -> np.ndarray:
    """Lower triangle of a correlation matrix; pivots below zero count as zero."""
    a = np.array(matrix, dtype=float)
    out = np.zeros_like(a)
    for k in range(len(a)):
        rest = a[k:, k] - out[k:, :k] @ out[k, :k]
        pivot = math.sqrt(max(rest[0], 0.0))
        out[k, k] = pivot
        out[k + 1 :, k] = rest[1:] / pivot if pivot else 0.0
    return out


def correlated_paths(spark: SparkSession, paths: int, matrix: list[list[float]], drift: list[float], volatility: list[float], horizon: float, seed: int = 7) -> DataFrame:
    """Final growth factors of correlated geometric Brownian paths, one row per
    path, drawn in the JVM."""
    lower = cholesky(matrix)
    draws = spark.range(paths).withColumns({f"_z{k}": F.randn(seed + k) for k in range(len(lower))})
    shock = [sum((F.col(f"_z{j}") * float(lower[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(lower))]
    growth = [F.exp((m - s * s / 2) * horizon + s * math.sqrt(horizon) * z) for m, s, z in zip(drift, volatility, shock, strict=True)]
    return draws.select(F.col("id").alias("path"), F.array(*growth).alias("growth"))


def greeks(value: Column, volatility: Column, bump: float = 0.01, days: float = 10.0) -> Column:
    """Finite-difference delta and gamma of a linear position, and its vega."""
    up, down = value * (1 + bump), value * (1 - bump)
    some = value != 0
    return F.struct(
        F.when(some, F.round((up - down) / (2 * bump * value), 6)).otherwise(0.0).alias("delta"),
        F.when(some, F.round((up - 2 * value + down) / F.pow(bump * value, F.lit(2.0)), 6)).otherwise(0.0).alias("gamma"),
        (value * math.sqrt(days / 252) * volatility).alias("vega"),
    )
