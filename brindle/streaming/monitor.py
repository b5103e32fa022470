"""Structured Streaming: sensor monitoring, live reaping and circuit breakers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.quality import alert_priority, threshold_breach


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def alerts(readings: DataFrame, limits: tuple[float, float, float, float]) -> DataFrame:
    """Readings that breach a threshold, with severity, deviation and priority.
    Stateless, so it runs on streams and tables alike."""
    low, high, critical_low, critical_high = (F.lit(float(x)) for x in limits)
    rows = readings.withColumn("b", threshold_breach(F.col("value"), low, high, critical_low, critical_high))
    return rows.select("*", "b.severity", "b.breached", "b.deviation").drop("b").filter("severity <> 'normal'").withColumn("priority", alert_priority(F.col("severity")))


def windowed_counts(readings: DataFrame, by: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window of event time; rows later than the watermark
    are left out and state behind it is dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = readings.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", F.col("total").cast("double").alias("total"))


def sessions(readings: DataFrame, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap without events."""
    out = readings.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(readings: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def breaker_stream(results: DataFrame, key: str = "handler", failures: int = 5, successes: int = 2, cooldown_ms: int = 60_000) -> DataFrame:
    """Circuit state changes per handler over ``results(handler, at_ms, failed)``:
    closed to open after consecutive failures, half open after a cool-down,
    closed again after successes. Keeps four numbers per handler."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, bad, good, since = state.get if state.exists else ("closed", 0, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("at_ms")
        for at, failed in zip(rows["at_ms"].tolist(), rows["failed"].tolist(), strict=True):
            before = mode
            if mode == "open" and at - since >= cooldown_ms:
                mode, good = "half_open", 0
            if failed:
                bad, good = bad + 1, 0
                if mode == "half_open" or (mode == "closed" and bad >= failures):
                    mode, since = "open", at
            else:
                bad, good = 0, good + 1
                if mode == "half_open" and good >= successes:
                    mode = "closed"
            if mode != before:
                out.append((k[0], at, before, mode))
        state.update((mode, bad, good, since))
        yield pd.DataFrame(out, columns=[key, "at_ms", "was", "state"])

    kind = dict(results.dtypes)[key]
    return results.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, at_ms long, was string, state string", "mode string, bad int, good int, since long", "append", GroupStateTimeout.NoTimeout
    )


def upsert_sink(folder: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key as versions of a
    Parquet table: a batch that is retried writes its version again."""
    from brindle.sources.files import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = [c for c in batch.columns if c != order]
        if number:
            store = spark.read.parquet(f"{folder}/version={number - 1}")
        else:
            store = batch.select(*fields).limit(0)
        upsert(store, batch, keys, order).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return write


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the sink's table. For tests
    and small results: the sink is in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into Parquet and read it back."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over what is there and read back all of its
    groups, those before the watermark's end too."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def limit_column(values: dict[str, float], key: Column, default: float) -> Column:
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(found, key), F.lit(default))
