"""Work queues, servers and step records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.parsing import backoff_ms
from brindle.operators.graph import reachable

DOWN_AFTER_MS = 300_000


def claimable(tasks: DataFrame, now: Column, names: list[str]) -> DataFrame:
    """Tasks that a worker may claim: pending and past their retry time, or
    running with an expired lease; the name is one of ``names`` or begins with
    one that ends in ``*``."""
    exact = [n for n in names if not n.endswith("*")]
    match = F.col("name").isin(*exact)
    for n in names:
        match = match | F.col("name").startswith(n[:-1]) if n.endswith("*") else match
    pending = (F.col("state") == "pending") & (F.coalesce("next_retry_after", F.lit(0)) <= now)
    expired = (F.col("state") == "running") & (F.col("lease_until") < now)
    return tasks.filter(match & (pending | expired))


def claim(tasks: DataFrame, now: Column, names: list[str], slots: int) -> DataFrame:
    """The oldest ``slots`` claimable tasks."""
    return claimable(tasks, now, names).orderBy("created", "task_id").limit(slots)


def server_state(state: Column, ping: Column, now: Column) -> Column:
    """``down`` for a running or starting server without a ping for 5 minutes."""
    stale = (ping == 0) | (now - ping > DOWN_AFTER_MS)
    return F.when(state.isin("running", "startup") & stale, "down").otherwise(state)


def retried(tasks: DataFrame, now: Column) -> DataFrame:
    """Put tasks back: one retry more, waiting longer each time; a task whose
    retries reach its limit (if it has one) is a dead letter."""
    tries = F.col("retry_count") + 1
    dead = (F.col("max_retries") > 0) & (tries >= F.col("max_retries"))
    return tasks.withColumns({"retry_count": tries, "state": F.when(dead, "dead_letter").otherwise("pending"), "next_retry_after": F.when(~dead, now + backoff_ms(tries))})


def reap_orphans(tasks: DataFrame, servers: DataFrame, now: Column, stale_ms: int = 60_000) -> DataFrame:
    """Running tasks of servers that are down or unknown and that have no recent
    heartbeat themselves, put back."""
    alive = servers.filter(server_state(F.col("server_state"), F.col("ping_time"), now) != "down").select("server_id")
    lost = tasks.filter(F.col("state") == "running").join(alive, "server_id", "left_anti")
    return retried(lost.filter(now - F.coalesce("heartbeat", F.lit(0)) > stale_ms), now)


def reap_stuck(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks without a sign of life for their timeout; a stage budget
    that has not run out exempts them."""
    sign = F.greatest(F.coalesce("heartbeat", F.lit(0)), F.coalesce("updated", F.lit(0)))
    budget = F.coalesce(F.col("budget_until") > now, F.lit(False))
    return retried(tasks.filter((F.col("state") == "running") & (F.col("timeout_ms") > 0) & (now - sign > F.col("timeout_ms")) & ~budget), now)


def step_category(state: Column) -> Column:
    # States of a step that count as running.
    running = ["state.facet.initialization.Begin", "state.facet.initialization.End", "state.statement.Created", "state.EventTransmit"]
    return F.when(state == "state.statement.Complete", "complete").when(state == "state.statement.Error", "error").when(state.isin(*running), "running").otherwise("other")


def progress(steps: DataFrame, key: str, category: Column) -> DataFrame:
    """completed, total and whole percent per run."""
    done = F.count_if(category == "complete")
    return steps.groupBy(key).agg(done.alias("completed"), F.count(F.lit(1)).alias("total"), F.floor(100 * done / F.count(F.lit(1))).cast("int").alias("pct"))


def timeline(steps: DataFrame, run: str) -> DataFrame:
    """Offset and width of each step in percent of its run, width at least 0.5.

    Steps without a start are left out. Bounds come from an aggregate that is
    joined back, not from a window over a whole run.
    """
    timed = steps.filter("start_ms > 0").withColumn("_end", F.greatest(F.coalesce("end_ms", "start_ms"), F.col("start_ms")))
    spans = timed.groupBy(run).agg(F.min("start_ms").alias("_from"), F.max("_end").alias("_to"))
    out = timed.join(spans, run).withColumn("_span", F.greatest(F.col("_to") - F.col("_from"), F.lit(1)))
    return out.withColumns(
        {
            "offset_pct": F.round(100.0 * (F.col("start_ms") - F.col("_from")) / F.col("_span"), 2),
            "width_pct": F.greatest(F.round(100.0 * F.greatest(F.col("_end") - F.col("start_ms"), F.lit(1)) / F.col("_span"), 2), F.lit(0.5)),
        }
    ).drop("_from", "_to", "_span", "_end")


def counts_by(df: DataFrame, group: str, state: str, states: list[str]) -> DataFrame:
    """One row per group, one column per state; states are fixed, so one pass."""
    return df.groupBy(group).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, by a partial aggregate instead of a sort."""
    fields = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row")).select(key, "_row.*").select(*df.columns)


def search(parts: dict[str, tuple[DataFrame, str, str]], needle: str) -> DataFrame:
    """Rows of several tables (kind -> table, id, label) whose label contains a
    text, ignoring case."""
    found = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).alias("label")) for kind, (df, key, label) in parts.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter(F.lower("label").contains(needle.lower()))


def actionable(steps: DataFrame, terminal: list[str], parked: list[str]) -> DataFrame:
    """Steps that are neither at an end nor waiting for an event."""
    return steps.filter(~F.col("state").isin(*terminal, *parked))


def repair(runs: DataFrame, steps: DataFrame, tasks: DataFrame, servers: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a repair would change: finished runs to reopen as they have live
    work, orphaned tasks, steps that failed for a passing reason, the failed steps
    that contain those (``containers(step_id, container_id)``, from
    ``steps.container_id`` where there is one), dead letters to queue again, and
    complete steps all of whose tasks failed."""
    live = tasks.filter(F.col("state").isin("pending", "running"))
    per_step = tasks.groupBy("step_id").agg(F.bool_and(F.col("state") == "failed").alias("_all_failed"))
    retry = steps.filter((F.col("state") == "error") & F.col("error").rlike("(?i)timeout|connection|unavailable"))
    found = {
        "reopen_runs": runs.filter(F.col("run_state") == "complete").join(live, "run_id", "left_semi"),
        "orphans": reap_orphans(tasks, servers, now),
        "retry_steps": retry,
        "dead_letters": tasks.filter(F.col("state") == "dead_letter"),
        "reopen_steps": steps.filter(F.col("state") == "complete").join(per_step.filter("_all_failed"), "step_id", "left_semi"),
    }
    if "container_id" in steps.columns:
        inside = steps.filter("container_id is not null").select(F.col("step_id").alias("src"), F.col("container_id").alias("dst"))
        above = reachable(inside, retry, "step_id").filter("hops > 0")
        found["reset_ancestors"] = steps.filter(F.col("state") == "error").join(above, "step_id", "left_semi").join(retry, "step_id", "left_anti")
    return found


def breaker(results: DataFrame, key: str, order: str, failures: int = 5) -> DataFrame:
    """Whether a closed circuit opens at a result: the ``failures``-th failure
    in a row. Runs of failures are told apart by the successes before. What
    happens after cool-down needs state: ``streaming.monitor.breaker_stream``."""
    seen = Window.partitionBy(key).orderBy(order)
    marked = results.withColumn("_run", F.sum((~F.col("failed")).cast("int")).over(seen))
    run = Window.partitionBy(key, "_run").orderBy(order)
    streak = F.sum(F.col("failed").cast("int")).over(run)
    return marked.withColumn("streak", streak).withColumn("opens", F.col("failed") & (F.col("streak") == failures)).drop("_run")
