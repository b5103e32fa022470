"""Work-queue, server, step and risk queries. Orders stand for tasks, suppliers
for servers, line items for steps; times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import parsing
from brindle.operators import fleet, risk
from brindle.plans.registry import query, table

NOW = 900_000_000_000

TASKS_SQL = f"""
    tasks AS (SELECT o_orderkey AS task_id, o_orderpriority AS name, o_custkey % 100 AS server_id,
        CASE WHEN o_orderkey % 35 = 3 THEN 'dead_letter' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' WHEN 3 THEN 'failed' ELSE 'running' END END AS state,
        epoch_ms(o_orderdate) AS created, epoch_ms(o_orderdate) + o_orderkey % 90000 AS updated, {NOW} - o_orderkey * 7919 % 240000 AS heartbeat, {NOW} + o_orderkey % 20001 - 10000 AS lease_until,
        {NOW} + o_orderkey % 3001 - 1500 AS next_retry_after, o_orderkey % 4 AS retry_count, o_orderkey % 3 + 1 AS max_retries, 60000 * (o_orderkey % 4) AS timeout_ms,
        CASE WHEN o_orderkey % 6 = 0 THEN {NOW} + 1 END AS budget_until FROM orders),
    servers AS (SELECT s_suppkey AS server_id, CASE s_suppkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'startup' WHEN 2 THEN 'shutdown' ELSE 'running' END AS server_state, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE {NOW} - s_suppkey % 60 * 10000 END AS ping_time FROM supplier)"""
PUT_BACK_SQL = f"""
    task_id, retry_count + 1 AS retry_count, CASE WHEN max_retries > 0 AND retry_count + 1 >= max_retries THEN 'dead_letter' ELSE 'pending' END AS state,
    CASE WHEN NOT (max_retries > 0 AND retry_count + 1 >= max_retries) THEN {NOW} + least(5000 * pow(2, retry_count + 1), 300000)::BIGINT END AS next_retry_after"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.unix_millis("o_orderdate")
    state = F.when(k % 35 == 3, "dead_letter").when(k % 5 == 0, "pending").when(k % 5 == 2, "complete").when(k % 5 == 3, "failed").otherwise("running")
    columns = {
        "task_id": k, "name": F.col("o_orderpriority"), "server_id": F.col("o_custkey") % 100, "state": state, "created": created, "updated": created + k % 90000, "heartbeat": F.lit(NOW) - k * 7919 % 240000,
        "lease_until": F.lit(NOW) + k % 20001 - 10000, "next_retry_after": F.lit(NOW) + k % 3001 - 1500, "retry_count": k % 4, "max_retries": k % 3 + 1, "timeout_ms": F.lit(60000) * (k % 4),
        "budget_until": F.when(k % 6 == 0, F.lit(NOW + 1)),
    }
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select(*[c.alias(n) for n, c in columns.items()])


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    state = F.when(k % 4 == 1, "startup").when(k % 4 == 2, "shutdown").otherwise("running")
    return table(spark, sf_dir, "supplier").select(k.alias("server_id"), state.alias("server_state"), F.when(k % 9 == 0, F.lit(0)).otherwise(F.lit(NOW) - k % 60 * 10000).alias("ping_time"))


@query("st2_claim", f"WITH {TASKS_SQL} SELECT task_id, name, state FROM tasks WHERE (name = '5-LOW' OR name LIKE '1-%') AND ((state = 'pending' AND next_retry_after <= {NOW}) OR (state = 'running' AND lease_until < {NOW})) ORDER BY created, task_id LIMIT 50")
def st2_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.claim(tasks(spark, sf_dir), F.lit(NOW), ["5-LOW", "1-*"], 50).select("task_id", "name", "state")


@query(
    "st3_reap_orphans",
    f"""
    WITH {TASKS_SQL}, alive AS (SELECT server_id FROM servers WHERE NOT (server_state IN ('running', 'startup') AND (ping_time = 0 OR {NOW} - ping_time > 300000)))
    SELECT {PUT_BACK_SQL} FROM tasks WHERE state = 'running' AND server_id NOT IN (SELECT server_id FROM alive) AND {NOW} - heartbeat > 60000""",
)
def st3_reap_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.reap_orphans(tasks(spark, sf_dir), servers(spark, sf_dir), F.lit(NOW)).select("task_id", "retry_count", "state", "next_retry_after")


@query("st4_reap_stuck", f"WITH {TASKS_SQL} SELECT {PUT_BACK_SQL} FROM tasks WHERE state = 'running' AND timeout_ms > 0 AND {NOW} - greatest(heartbeat, updated) > timeout_ms AND NOT coalesce(budget_until > {NOW}, false)")
def st4_reap_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.reap_stuck(tasks(spark, sf_dir), F.lit(NOW)).select("task_id", "retry_count", "state", "next_retry_after")


@query("st5_log_tail", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100")
def st5_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("ts > timestamp'2024-01-20 00:00:00'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@query("t1_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def t1_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("t5_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def t5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey", "c_acctbal")


@query(
    "st7_circuit_breaker",
    """
    WITH r AS (SELECT user_id, event_id, value > 30 AS failed FROM events), m AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
    s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM m) SELECT user_id, event_id, streak::BIGINT AS streak FROM s WHERE failed AND streak = 5""",
)
def st7_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 30).alias("failed"))
    return fleet.breaker(results, "user_id", "event_id").filter("opens").select("user_id", "event_id", "streak")


STATES = ["pending", "running", "complete", "failed"]


@query("a40_counts_by_state", f"WITH {TASKS_SQL} SELECT name, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + ", count(*) AS total FROM tasks GROUP BY name")
def a40_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.counts_by(tasks(spark, sf_dir), "name", "state", STATES)


@query("x6_store_group_count", f"WITH {TASKS_SQL} SELECT state, count(*) AS tasks FROM tasks GROUP BY state")
def x6_store_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("tasks"))


@query("j16_tasks_by_server", f"WITH {TASKS_SQL} SELECT s.server_id, server_state, count(task_id) AS tasks, count(*) FILTER (state = 'running') AS running FROM servers s LEFT JOIN tasks t ON t.server_id = s.server_id GROUP BY 1, 2")
def j16_tasks_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = tasks(spark, sf_dir).groupBy("server_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("state") == "running").alias("running"))
    return servers(spark, sf_dir).join(per, "server_id", "left").na.fill(0, ["tasks", "running"]).select("server_id", "server_state", "tasks", "running")


@query("f28_server_state", f"WITH {TASKS_SQL} SELECT server_id, CASE WHEN server_state IN ('running', 'startup') AND (ping_time = 0 OR {NOW} - ping_time > 300000) THEN 'down' ELSE server_state END AS state FROM servers")
def f28_server_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return servers(spark, sf_dir).select("server_id", fleet.server_state(F.col("server_state"), F.col("ping_time"), F.lit(NOW)).alias("state"))


@query("a41_progress", "SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS completed, count(*) AS total, floor(100 * count(*) FILTER (l_linestatus = 'F') / count(*))::INT AS pct FROM lineitem GROUP BY 1")
def a41_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_linestatus") == "F", "state.statement.Complete").otherwise("state.statement.Created")
    return fleet.progress(table(spark, sf_dir, "lineitem"), "l_orderkey", fleet.step_category(state))


@query(
    "w7_timeline",
    """
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch_ms(l_shipdate) AS a, epoch_ms(l_shipdate) + (l_quantity * 3600000)::BIGINT AS b FROM lineitem), g AS (SELECT l_orderkey, min(a) AS f, max(b) AS t FROM s WHERE a > 0 GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, round(100.0::DOUBLE * (a - f) / greatest(t - f, 1), 2) AS offset_pct, greatest(round(100.0::DOUBLE * greatest(b - a, 1) / greatest(t - f, 1), 2), 0.5) AS width_pct FROM s JOIN g USING (l_orderkey) WHERE a > 0""",
)
def w7_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", start.alias("start_ms"), (start + (F.col("l_quantity") * 3600000).cast("long")).alias("end_ms"))
    return fleet.timeline(steps, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "offset_pct", "width_pct")


@query("w8_latest_task", f"WITH {TASKS_SQL} SELECT server_id, arg_max(task_id, (created, task_id)) AS task_id, arg_max(state, (created, task_id)) AS state FROM tasks GROUP BY 1")
def w8_latest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.latest(tasks(spark, sf_dir).select("server_id", "task_id", "state", "created"), "server_id", ["created", "task_id"]).select("server_id", "task_id", "state")


@query("f30_search", "SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '77') UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier WHERE contains(lower(s_name), '77') UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part WHERE contains(lower(p_name), '77')")
def f30_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"customer": (table(spark, sf_dir, "customer"), "c_custkey", "c_name"), "supplier": (table(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), "part": (table(spark, sf_dir, "part"), "p_partkey", "p_name")}
    return fleet.search(parts, "77")


@query("c18_actionable_steps", f"WITH {TASKS_SQL} SELECT task_id, state FROM tasks WHERE state NOT IN ('complete', 'failed', 'pending')")
def c18_actionable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.actionable(tasks(spark, sf_dir), ["complete", "failed"], ["pending"]).select("task_id", "state")


@query("u5_runs_to_resume", f"WITH {TASKS_SQL} SELECT DISTINCT server_id FROM tasks WHERE state = 'running'")
def u5_runs_to_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).filter("state = 'running'").select("server_id").distinct()


@query(
    "c19_repair",
    f"""
    WITH {TASKS_SQL}, alive AS (SELECT server_id FROM servers WHERE NOT (server_state IN ('running', 'startup') AND (ping_time = 0 OR {NOW} - ping_time > 300000))),
    per AS (SELECT server_id, bool_and(state = 'failed') AS f FROM tasks GROUP BY 1),
    ids AS (SELECT DISTINCT server_id FROM tasks), up AS (SELECT server_id FROM ids WHERE server_id % 3 = 2 AND server_id % 10 <> 0 AND server_id - 1 IN (SELECT server_id FROM ids))
    SELECT 'orphans' AS rule, count(*) AS n FROM tasks WHERE state = 'running' AND server_id NOT IN (SELECT server_id FROM alive) AND {NOW} - heartbeat > 60000
    UNION ALL SELECT 'reopen_runs', count(DISTINCT server_id) FROM tasks WHERE server_id % 2 = 0 AND state IN ('pending', 'running')
    UNION ALL SELECT 'retry_steps', (SELECT count(*) FROM (SELECT DISTINCT server_id FROM tasks) WHERE server_id % 3 = 1)
    UNION ALL SELECT 'reopen_steps', (SELECT count(*) FROM per WHERE f AND server_id % 3 = 0)
    UNION ALL SELECT 'dead_letters', count(*) FROM tasks WHERE state = 'dead_letter'
    UNION ALL SELECT 'reset_ancestors', count(*) FROM up""",
)
def c19_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).withColumn("run_id", F.col("server_id")).withColumn("step_id", F.col("server_id"))
    ids = t.select("server_id").distinct()
    k = F.col("server_id")
    runs = ids.select(k.alias("run_id"), F.when(k % 2 == 0, "complete").otherwise("running").alias("run_state"))
    steps = ids.select(k.alias("step_id"), F.when(k % 3 == 0, "complete").otherwise("error").alias("state"), F.when(k % 3 == 1, "Connection reset").when(k % 3 == 2, "a step inside failed").alias("error"), F.when(k % 10 != 9, k + 1).alias("container_id"))
    found = fleet.repair(runs, steps, t, servers(spark, sf_dir), F.lit(NOW))
    out = None
    for rule, rows in found.items():
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("f29_backoff", "SELECT o_orderkey, least(5000 * pow(2, o_orderkey % 12), 300000)::BIGINT AS wait_ms FROM orders")
def f29_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.backoff_ms(F.col("o_orderkey") % 12).alias("wait_ms"))


@query(
    "f26_duration",
    """
    WITH d AS (SELECT o_orderkey, o_orderkey * 9973 % 400000000 AS ms FROM orders), s AS (SELECT *, ms // 1000 AS s FROM d)
    SELECT o_orderkey, CASE WHEN ms = 0 THEN '\u2014' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS duration,
           CASE WHEN ms = 0 THEN '\u2014' WHEN s >= 86400 THEN (s // 86400) || ':' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') ELSE (s // 3600)::VARCHAR END || CASE WHEN ms = 0 THEN '' ELSE ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS long,
           CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h' || CASE WHEN s % 3600 >= 60 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END || ' ago'
                ELSE (s // 86400) || 'd' || CASE WHEN s % 86400 >= 3600 THEN ' ' || (s % 86400 // 3600) || 'h' ELSE '' END || ' ago' END AS ago FROM s""",
)
def f26_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 9973 % 400000000).alias("ms"))
    return d.select("o_orderkey", parsing.duration(F.col("ms")).alias("duration"), parsing.duration_long(F.col("ms")).alias("long"), parsing.ago(F.lit(NOW) - F.col("ms"), F.lit(NOW)).alias("ago"))


@query("f27_name_parts", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'osm.' || o_orderstatus ELSE 'system.unnamespaced' END AS namespace, o_orderpriority AS short_name FROM orders")
def f27_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(".", F.lit("osm"), "o_orderstatus", "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.namespace_of(name).alias("namespace"), parsing.short_name(name).alias("short_name"))


@query("f25_hashes", "SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS md FROM customer")
def f25_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"), F.md5("c_name").alias("md"))


# ---- risk -----------------------------------------------------------------

PNL_SQL = "pnl AS (SELECT l_suppkey, l_extendedprice / 100 - l_quantity * 15 AS v FROM lineitem), r AS (SELECT l_suppkey, list_sort(list(v)) AS x FROM pnl GROUP BY 1)"


def _pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 100 - F.col("l_quantity") * 15).alias("v"))


@query("a33_value_at_risk", f"WITH {PNL_SQL} SELECT l_suppkey, x[least(floor(0.05::DOUBLE * len(x) + 1e-9)::BIGINT, len(x) - 1) + 1] AS var FROM r")
def a33_value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.tail_risk(_pnl(spark, sf_dir), ["l_suppkey"], "v", 0.95).select("l_suppkey", "var")


@query(
    "a34_expected_shortfall",
    f"WITH {PNL_SQL}, q AS (SELECT l_suppkey, x[least(floor(0.05::DOUBLE * len(x) + 1e-9)::BIGINT, len(x) - 1) + 1] AS var FROM r) SELECT l_suppkey, round(sum(v::DECIMAL(18,4))::DOUBLE / count(*), 6) AS cvar FROM pnl JOIN q USING (l_suppkey) WHERE v <= var GROUP BY 1",
)
def a34_expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.tail_risk(_pnl(spark, sf_dir), ["l_suppkey"], "v", 0.95).select("l_suppkey", F.round("cvar", 6).alias("cvar"))


@query(
    "x10_risk_summary",
    f"""
    WITH {PNL_SQL}, q AS (SELECT l_suppkey, x[least(floor(0.05::DOUBLE * len(x) + 1e-9)::BIGINT, len(x) - 1) + 1] AS var95, x[least(floor(0.01::DOUBLE * len(x) + 1e-9)::BIGINT, len(x) - 1) + 1] AS var99 FROM r),
    s AS (SELECT l_suppkey, abs(min(v)) AS max_drawdown, stddev_samp(v) AS std, sum(v::DECIMAL(18,4))::DOUBLE / count(v) AS mean, count(*) AS n FROM pnl GROUP BY 1)
    SELECT l_suppkey, max_drawdown, round(std, 6) AS std, round(CASE WHEN coalesce(std, 0) > 0 THEN mean / std ELSE 0 END, 6) AS sharpe, n, var95, var99 FROM s JOIN q USING (l_suppkey)""",
)
def x10_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.summary(_pnl(spark, sf_dir), ["l_suppkey"], "v")
    return out.select("l_suppkey", "max_drawdown", F.round("std", 6).alias("std"), F.round("sharpe", 6).alias("sharpe"), "n", "var95", "var99")


@query(
    "x11_stress",
    """
    WITH pos AS (SELECT o_custkey AS book, o_orderpriority AS asset, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1, 2),
    sc(scenario, asset, shock) AS (VALUES ('crash', '1-URGENT', -0.4), ('crash', '2-HIGH', -0.2), ('crash', '5-LOW', 0.05), ('rates', '2-HIGH', 0.1), ('rates', '3-MEDIUM', -0.15)),
    e AS (SELECT book, scenario, asset, value * shock::DOUBLE AS effect FROM pos JOIN sc USING (asset))
    SELECT book, scenario, sum(effect::DECIMAL(18,4))::DOUBLE AS pnl, arg_min(asset, (effect, asset)) AS worst_asset, arg_min(asset, (-effect, asset)) AS best_asset FROM e GROUP BY 1, 2""",
)
def x11_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book"), F.col("o_orderpriority").alias("asset")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    shocks = [("crash", "1-URGENT", -0.4), ("crash", "2-HIGH", -0.2), ("crash", "5-LOW", 0.05), ("rates", "2-HIGH", 0.1), ("rates", "3-MEDIUM", -0.15)]
    return risk.stress(pos, spark.createDataFrame(shocks, "scenario string, asset string, shock double"), "book")


@query("f22_greeks", "SELECT o_orderkey, CASE WHEN o_totalprice <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS delta, round(o_totalprice * sqrt(10.0 / 252) * 0.2, 4) AS vega FROM orders")
def f22_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = risk.greeks(F.col("o_totalprice"), F.lit(0.2))
    return table(spark, sf_dir, "orders").select("o_orderkey", g.alias("g")).select("o_orderkey", "g.delta", F.round("g.vega", 4).alias("vega"))


@query("f22_correlated_paths")
def f22_correlated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.correlated_paths(spark, 1000, [[1.0, 0.5], [0.5, 1.0]], [0.05, 0.02], [0.2, 0.1], 10 / 252)
