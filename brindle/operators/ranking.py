"""Rankings, rounds, splits and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], metric: str, position: str) -> DataFrame:
    """Rank 1 for the highest metric; a missing metric counts as 0, ties keep
    their order."""
    order = [F.desc(F.coalesce(F.col(metric), F.lit(0))), F.col(position)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def improvement(df: DataFrame, key: str, order: list[str], score: str, first: float = 50.0) -> DataFrame:
    """Score over the previous round's, at least 1; the first round's previous
    score is ``first``."""
    before = F.lag(score, 1, first).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("improvement", F.col(score) / F.greatest(before, F.lit(1.0)))


def convergence(rounds: DataFrame, key: str, order: str, score: str, first: float = 50.0, limit: float = 0.1) -> DataFrame:
    """Relative change of the average score from round to round."""
    before = F.lag(score, 1, first).over(Window.partitionBy(key).orderBy(order))
    return rounds.withColumn("delta", F.abs(F.col(score) - before) / F.greatest(before, F.lit(1.0))).withColumn("converged", F.col("delta") < limit)


def numbered(df: DataFrame, key: str, out: str = "place") -> DataFrame:
    """Add places 0, 1, 2, ... in the order of the keys' hashes, and ``rows``,
    how many there are. Rows are ranked inside 65,536 ranges of the hash and
    each range starts where those before it end, so no task holds the table."""
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_range", F.substring("_hash", 1, 4))
    sums = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # 65,536 rows at most
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("rows"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", key))
    return hashed.withColumn("_within", within).join(F.broadcast(sums), "_range").withColumn(out, F.col("_before") + F.col("_within") - 1).drop("_hash", "_range", "_within", "_before")


def split(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """A deterministic split by count: of n rows in hashed order each part gets
    int(share * n), the last one the rest."""
    rows = numbered(df, key, "_place")
    part: Column | None = None
    upto = F.lit(0).cast("long")
    for name, share in list(shares.items())[:-1]:
        upto = upto + F.floor(F.col("rows") * share)
        part = F.when(F.col("_place") < upto, name) if part is None else part.when(F.col("_place") < upto, name)
    last = list(shares)[-1]
    return rows.withColumn("part", F.lit(last) if part is None else part.otherwise(last)).drop("_place", "rows")


def binary_metrics(df: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 from one pass over the confusion counts; 0 where undefined."""
    hit = F.count_if(F.col(actual) & F.col(predicted))
    false, missed = F.count_if(~F.col(actual) & F.col(predicted)), F.count_if(F.col(actual) & ~F.col(predicted))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        zero(F.try_divide(hit, hit + false)).alias("precision"), zero(F.try_divide(hit, hit + missed)).alias("recall"), zero(F.try_divide(2 * hit, 2 * hit + false + missed)).alias("f1")
    )
