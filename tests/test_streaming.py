"""Streams drained over small folders."""

from pyspark.sql import functions as F

from brindle.streaming import monitor


def stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_breaker_opens_and_closes(spark, tmp_path):
    failed = [True] * 5 + [False, False, False]
    at = [0, 1, 2, 3, 4, 70_000, 70_001, 70_002]
    df = spark.createDataFrame([("h", a, f) for a, f in zip(at, failed, strict=True)], "handler string, at_ms long, failed boolean").coalesce(1)
    out = monitor.drain_to(monitor.breaker_stream(stream(spark, df, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r["at_ms"], r["was"], r["state"]) for r in out.collect()) == [(4, "closed", "open"), (70_001, "open", "closed")] or sorted(
        (r["at_ms"], r["was"], r["state"]) for r in out.collect()
    ) == [(4, "closed", "open"), (70_000, "open", "half_open"), (70_001, "half_open", "closed")]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{h}:10:00", "a", 1.0) for k, h in enumerate((0, 0, 1, 5))]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).coalesce(1)
    out = monitor.drain_to(monitor.windowed_counts(stream(spark, df, f"{tmp_path}/in"), "event_type", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r["window_start"].hour, r["n"]) for r in out) == [(0, 2), (1, 1)]


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = monitor.upsert_sink(str(tmp_path / "store"), ["k"], "at")
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    second = spark.createDataFrame([(1, "c", 3), (2, "d", 1)], "k int, v string, at int")
    write(first, 0)
    for _ in range(2):
        write(second, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/store/version=1").collect())) == [(1, "c"), (2, "d")]


def test_alerts_run_on_tables_too(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 50.0), (3, 85.0)], "event_id long, value double")
    assert sorted((r["event_id"], r["severity"], r["priority"]) for r in monitor.alerts(df, (20, 80, 5, 95)).collect()) == [(1, "critical", 1), (3, "warning", 2)]
