"""Data-quality checks, sensor rules and remediation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): errors list their missing fields. A missing field is a
    null one here, as columns are always present."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = df.withColumn("missing_fields", missing)
    return marked.filter(F.size("missing_fields") == 0).drop("missing_fields"), marked.filter(F.size("missing_fields") > 0)


def keep_first(df: DataFrame, key: str, order: str, renames: dict[str, str] | None = None, drop_empty: bool = True) -> DataFrame:
    """Rename, drop rows with an empty key if asked, keep the first per key;
    rows without a key share the empty one."""
    keyed = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    keyed = keyed.filter(F.col(key) != "") if drop_empty else keyed
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row"))
    out = best.select(key, "_row.*").select(*df.columns)
    return out.withColumnsRenamed(renames or {})


def profile(df: DataFrame) -> DataFrame:
    """column_name, dtype, missing_count, distinct_count, row_count per column,
    in one pass."""
    kinds = dict(df.dtypes)
    stats = df.agg(F.count(F.lit(1)).alias("_rows"), *[x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_distinct(F.col(c)).alias(f"d_{c}"))])
    per = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.col(f"m_{c}").alias("missing_count"), F.col(f"d_{c}").alias("distinct_count")) for c in df.columns])
    return stats.select(F.col("_rows").alias("row_count"), F.inline(per))


def completeness(profiles: DataFrame, most_missing: float) -> DataFrame:
    """One check per column: missing rate against the limit (inclusive)."""
    rate = F.col("missing_count") / F.greatest(F.col("row_count"), F.lit(1))
    return profiles.select(F.concat(F.lit("completeness:"), "column_name").alias("check_name"), (rate <= most_missing).alias("passed"), (1 - rate).alias("score"))


def accuracy(df: DataFrame, kinds: dict[str, str], most_errors: int) -> DataFrame:
    """One check per column: values that do not read as the declared type."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(kind).isNull()).alias(c) for c, kind in kinds.items()])
    errors = bad.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("errors")) for c in kinds])))
    score = F.greatest(F.lit(0.0), 1 - F.col("errors") / max(2 * most_errors, 1))
    return errors.select(F.concat(F.lit("accuracy:"), "column_name").alias("check_name"), (F.col("errors") <= most_errors).alias("passed"), score.alias("score"))


def anomalous(profiles: DataFrame, limit: float) -> DataFrame:
    """Columns whose missing rate exceeds the limit."""
    rate = F.col("missing_count") / F.greatest(F.col("row_count"), F.lit(1))
    return profiles.select("column_name", rate.alias("missing_rate")).filter(F.col("missing_rate") > limit)


def weighted_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    return sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def grade(score: Column) -> Column:
    out = F.when(score >= 0.9, "A")
    for least, letter in ((0.8, "B"), (0.7, "C"), (0.6, "D")):
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def remediation(flagged: DataFrame, checks: DataFrame) -> DataFrame:
    """Actions with a running priority: flagged columns, then failed checks."""
    first = flagged.select(F.lit(0).alias("_part"), F.lit("fill_missing").alias("action"), F.col("column_name").alias("target_column"))
    action = F.when(F.col("check_name").contains("accuracy"), "fix_type_errors").otherwise("fill_missing")
    then = checks.filter(~F.col("passed")).select(F.lit(1).alias("_part"), action.alias("action"), F.substring_index("check_name", ":", -1).alias("target_column"))
    order = Window.orderBy("_part", "target_column", "action")  # a row per column of the data set
    return first.unionByName(then).withColumn("priority", F.row_number().over(order)).drop("_part")


# ---- sensors --------------------------------------------------------------


def threshold_breach(value: Column, low: Column, high: Column, critical_low: Column, critical_high: Column) -> Column:
    """Struct (severity, breached, deviation): the first of critical low,
    critical high, low and high that the value reaches."""
    ladder = [("critical", "critical_low", value <= critical_low, critical_low - value), ("critical", "critical_high", value >= critical_high, value - critical_high),
              ("warning", "low", value <= low, low - value), ("warning", "high", value >= high, value - high)]
    severity, breached, deviation = F.lit("normal"), F.lit("none"), F.lit(0.0)
    for s, b, condition, d in reversed(ladder):
        severity, breached, deviation = F.when(condition, s).otherwise(severity), F.when(condition, b).otherwise(breached), F.when(condition, d).otherwise(deviation)
    return F.struct(severity.alias("severity"), breached.alias("breached"), deviation.alias("deviation"))


def alert_priority(severity: Column, priorities: dict[str, int] | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for pair in (priorities or {"critical": 1, "warning": 2, "normal": 3}).items() for x in pair])
    return F.coalesce(F.try_element_at(found, severity), F.lit(3))


def calibrated(value: Column, scale: Column, offset: Column, low: Column, high: Column) -> Column:
    """Struct (calibrated, valid); unknown scale and offset leave the value,
    unknown bounds are -999 and 999."""
    c = value * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))
    return F.struct(c.alias("calibrated"), c.between(F.coalesce(low, F.lit(-999.0)), F.coalesce(high, F.lit(999.0))).alias("valid"))


def reading_kind(readings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``initial`` for a sensor's first reading, else ``continuous``."""
    before = F.lag(F.lit(1)).over(Window.partitionBy(key).orderBy(*order))
    return readings.withColumn("quality", F.when(before.isNull(), "initial").otherwise("continuous"))


def deploy_risk(score: Column, change_size: Column, environment: Column) -> Column:
    """Struct (level, score, factors) of a deployment with a base score."""
    production = environment == "production"
    raised = F.when(production, F.least(F.lit(100), score + 15)).otherwise(score)
    factors = F.array_compact(F.array(F.when(score > 80, "large change set"), F.when(change_size > 100, "high line count"), F.when(production, "production target")))
    level = F.when(raised >= 80, "critical").when(raised >= 50, "medium").otherwise("low")
    return F.struct(level.alias("level"), raised.alias("score"), factors.alias("factors"))


def triage(checks: Column) -> Column:
    """Struct (severity, failed) of a map of check results."""
    failed = F.array_sort(F.map_keys(F.map_filter(checks, lambda _, v: ~v.eqNullSafe("pass"))))
    severity = F.when(F.size(failed) >= 3, "critical").when(F.size(failed) >= 1, "warning").otherwise("info")
    return F.struct(severity.alias("severity"), failed.alias("failed"))
