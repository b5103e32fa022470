"""Dataflow, expression, ranking, graph and text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import expressions as ex
from brindle.functions import parsing, text
from brindle.operators import graph, ranking, routing
from brindle.plans.registry import query, table

# ---- expressions ----------------------------------------------------------


@query("e4_concat", "SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, '') || CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END || l_linenumber || coalesce(CASE WHEN l_tax > 0.05 THEN 'x' END, '') AS label FROM lineitem")
def e4_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = ex.join_text((F.col("l_returnflag"), "string"), (F.col("l_quantity") > 25, "boolean"), (F.col("l_linenumber"), "int"), (F.when(F.col("l_tax") > 0.05, "x"), "string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("e5_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_linenumber - l_tax AS a, l_orderkey / l_linenumber AS b, CASE WHEN l_linenumber <> 0 THEN (l_orderkey % 17 - 8) - 5 * floor((l_orderkey % 17 - 8) / 5.0)::BIGINT END AS c FROM lineitem")
def e5_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 17 - 8
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 2 + F.col("l_linenumber") - F.col("l_tax")).alias("a"), ex.divide(F.col("l_orderkey"), F.col("l_linenumber")).alias("b"), ex.modulo(k, F.lit(5)).alias("c")
    )


@query("e8_equality", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderpriority, '1-URGENT') AS same FROM orders")
def e8_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.nullif(F.col("o_orderstatus"), F.lit("F")), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ex.same(a, b).alias("same"))


@query("e10_truthiness", "SELECT o_orderkey, (o_custkey % 3 <> 0) AND o_totalprice > 1000 AS both, (o_custkey % 3 <> 0) OR coalesce(nullif(o_orderstatus, 'O') <> '', false) AS either, NOT (o_custkey % 3 <> 0) AS neither FROM orders")
def e10_truthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ex.truthy(F.col("o_custkey") % 3, "long")
    s = ex.truthy(F.nullif(F.col("o_orderstatus"), F.lit("O")), "string")
    return table(spark, sf_dir, "orders").select("o_orderkey", ex.both(a, ex.ordered(F.col("o_totalprice"), F.lit(1000.0), ">")).alias("both"), ex.either(a, s).alias("either"), (~a).alias("neither"))


@query("e13_index", "WITH a AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, v[1] AS first, v[len(v)] AS last FROM a")
def e13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("v"))
    return a.select("l_orderkey", ex.item(F.col("v"), F.lit(0)).alias("first"), ex.item(F.col("v"), F.lit(-1)).alias("last"))


@query("e2_input_reference", "SELECT o_orderkey, o_orderpriority AS shadowed, o_orderstatus AS nested, [o_orderkey, o_custkey] AS both, o_custkey AS last FROM orders")
def e2_input_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and step references, and literals: the loop's variable hides the
    input of its name, a property of an object is found by path."""
    inputs = F.create_map(F.lit("item"), F.lit("hidden"), F.lit("order"), F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("state"))))
    last = ex.map_literal([("a", F.col("o_orderkey")), ("b", F.lit(0).cast("long")), ("b", F.col("o_custkey"))])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ex.input_value(inputs, "item", loop=("item", F.col("o_orderpriority"))).alias("shadowed"), ex.input_value(inputs, "order", "state", "status").alias("nested"),
        ex.list_literal(F.col("o_orderkey"), F.col("o_custkey")).alias("both"), ex.step_value(last, "s", "b").alias("last"),
    )


@query("p3_default_fill", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'normal' END AS priority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'all' END AS scope FROM orders")
def p3_default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text_null = F.lit(None).cast("string")
    # key given as null, given, or not given
    given = F.map_concat(
        F.when(k % 3 == 0, F.create_map(F.lit("priority"), text_null)).when(k % 3 == 1, F.create_map(F.lit("priority"), F.col("o_orderpriority"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(k % 2 == 0, F.create_map(F.lit("scope"), F.col("o_orderstatus"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    filled = ex.with_defaults(given, {"priority": F.lit("normal"), "scope": F.lit("all")})
    return table(spark, sf_dir, "orders").select("o_orderkey", filled.alias("p")).select("o_orderkey", F.col("p")["priority"].alias("priority"), F.col("p")["scope"].alias("scope"))


# ---- dataflow -------------------------------------------------------------


@query("c1_workflow_arithmetic", "SELECT c_custkey, ((c_custkey + 1) + 1) + 1 AS output FROM customer")
def c1_workflow_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = routing.call(table(spark, sf_dir, "customer"), {"input": F.col("c_custkey") + 1}, keep=["c_custkey"])
    s2 = routing.call(s1, {"input": F.col("input") + 1}, keep=["c_custkey"])
    return routing.call(s2, {"output": F.col("input") + 1}, keep=["c_custkey"])


@query("c4_foreach", "SELECT o_orderkey, i::INT AS position, s AS tag FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS s, unnest([0, 1]) AS i FROM orders WHERE o_orderkey % 2 = 0)")
def c4_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return routing.foreach(table(spark, sf_dir, "orders").select("o_orderkey", values.alias("tags")), "tags", "tag").select("o_orderkey", "position", "tag")


@query(
    "p4_route",
    """
    SELECT o_orderkey, 'large' AS lane, o_totalprice * 0.9 AS amount FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'urgent', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'plain', o_totalprice FROM orders WHERE NOT (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')""",
)
def p4_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = lambda name, factor=1.0: {"o_orderkey": F.col("o_orderkey"), "lane": F.lit(name), "amount": F.col("o_totalprice") * factor}
    cases = [(F.col("o_totalprice") > 200000, lane("large", 0.9)), (F.col("o_orderpriority") == "1-URGENT", lane("urgent"))]
    return routing.route(table(spark, sf_dir, "orders"), cases, default=lane("plain"))


@query("a44_last_writer", "SELECT l_orderkey, arg_max(l_returnflag, l_linenumber::DOUBLE * 1000000000 + l_extendedprice) FILTER (l_returnflag <> 'N') AS flag, arg_max(l_quantity, l_linenumber::DOUBLE * 1000000000 + l_extendedprice) AS quantity FROM lineitem GROUP BY 1")
def a44_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), F.col("l_quantity").alias("quantity"), (F.col("l_linenumber").cast("double") * 1000000000 + F.col("l_extendedprice")).alias("at"))
    return routing.last_writer(rows, ["l_orderkey"], "at", ["flag", "quantity"])


ATTEMPT_SQL = """
    t AS (SELECT o_orderkey, o_custkey % 50 AS grp, CASE WHEN o_custkey % 7 = 0 THEN 'ZeroDivisionError' WHEN o_totalprice < 5000 THEN 'ValueError' END AS error_type,
                 CASE WHEN o_custkey % 7 = 0 THEN 'division by zero' WHEN o_totalprice < 5000 THEN 'too small' END AS error, CASE WHEN o_custkey % 7 <> 0 AND o_totalprice >= 5000 THEN o_totalprice / (o_custkey % 7) END AS share FROM orders)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("grp"), "o_custkey", "o_totalprice")
    checks = [(F.col("o_custkey") % 7 == 0, "ZeroDivisionError", "division by zero"), (F.col("o_totalprice") < 5000, "ValueError", "too small")]
    return routing.attempt(rows, {"share": F.try_divide(F.col("o_totalprice"), F.col("o_custkey") % 7)}, checks).select("o_orderkey", "grp", "error_type", "error", "share")


@query("c7_catch", f"WITH {ATTEMPT_SQL} SELECT o_orderkey, CASE WHEN error_type = 'ZeroDivisionError' THEN -1.0 ELSE share END AS share, CASE WHEN error_type = 'ZeroDivisionError' THEN error END AS caught FROM t")
def c7_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    handler = {"caught": F.col("error"), "share": F.lit(-1.0)}
    return routing.catch(_attempts(spark, sf_dir), handler, when=F.col("error_type") == "ZeroDivisionError").select("o_orderkey", "share", "caught")


@query("c8_block_outcome", f"WITH {ATTEMPT_SQL} SELECT grp, count(*) AS steps, count(error_type) AS failed, arg_min(error, o_orderkey) FILTER (error IS NOT NULL) AS error FROM t GROUP BY grp")
def c8_block_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.block_outcome(_attempts(spark, sf_dir), ["grp"], "o_orderkey")


@query("c12_timeouts", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 5000 ELSE (o_custkey % 3) * 3600000 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 15 * 60000 END + 30000 END AS timeout_ms FROM orders")
def c12_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = routing.timeout_ms(F.col("o_custkey") % 3, F.when(F.col("o_custkey") % 2 != 0, 15), F.lit(30))
    return table(spark, sf_dir, "orders").select("o_orderkey", routing.option(declared, F.when(F.col("o_orderkey") % 4 == 0, F.lit(5000).cast("long"))).alias("timeout_ms"))


@query("u4_merge_yields", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def u4_merge_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return routing.merge(a, b)


@query("x23_run_outcome", "SELECT o_orderkey, o_orderstatus = 'F' AS success, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total, CASE WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_orderstatus <> 'F' THEN 'did not complete' END AS error FROM orders")
def x23_run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running")
    r = routing.outcome(state, F.struct(F.col("o_totalprice").alias("total")), F.when(F.col("o_orderstatus") == "P", "partial"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.success", "r.outputs.total", "r.error")


# ---- graphs ---------------------------------------------------------------

TREE_SQL = "t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 3 END AS parent FROM part)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 1, F.floor(k / 3).cast("long")).alias("parent"))


@query(
    "c16_step_tree",
    f"WITH RECURSIVE {TREE_SQL}, d AS (SELECT id, 0 AS depth FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, d.depth + 1 FROM t JOIN d ON t.parent = d.id) SELECT id, depth::INT AS depth FROM d",
)
def c16_step_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(_tree(spark, sf_dir))


LAYER_SQL = "n AS (SELECT p_partkey AS id FROM part), e AS (SELECT id // 2 AS src, id AS dst FROM n WHERE id // 2 >= 1 UNION SELECT id - 7, id FROM n WHERE id % 5 = 0 AND id > 7)"


def _layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    e = n.select(F.floor(F.col("id") / 2).cast("long").alias("src"), F.col("id").alias("dst")).filter("src >= 1")
    return n, e.unionByName(n.filter("id % 5 = 0 and id > 7").select((F.col("id") - 7).alias("src"), F.col("id").alias("dst"))).distinct()


@query(
    "t2_topological_layers",
    f"WITH RECURSIVE {LAYER_SQL}, w AS (SELECT id, 0 AS level FROM n UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id) SELECT id, max(level)::INT AS level FROM w GROUP BY id",
)
def t2_topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers(*_layered(spark, sf_dir))


@query("t3_ready_steps", f"WITH {LAYER_SQL}, done AS (SELECT id FROM n WHERE id <= 60) SELECT id AS step_id FROM n WHERE id > 60 AND NOT EXISTS (SELECT 1 FROM e WHERE dst = n.id AND src NOT IN (SELECT id FROM done))")
def t3_ready_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _layered(spark, sf_dir)
    needs = n.join(e.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("needs")), "id", "left").select(F.col("id").alias("step_id"), F.coalesce("needs", F.array().cast("array<long>")).alias("needs"))
    return routing.ready(needs, n.filter("id <= 60").select(F.col("id").alias("step_id"))).select("step_id")


@query("c17_downstream", f"WITH RECURSIVE {LAYER_SQL}, r AS (SELECT 6::BIGINT AS id UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r")
def c17_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _layered(spark, sf_dir)
    return graph.reachable(e, spark.createDataFrame([(6,)], "id long")).select("id")


RETRY_SQL = f"{LAYER_SQL}, st AS (SELECT id, CASE WHEN id % 97 = 5 THEN 'failed' WHEN id % 11 = 0 THEN 'created' ELSE 'complete' END AS state FROM n), r AS (SELECT id FROM st WHERE state = 'failed' UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)"


@query("c17_retry", f"WITH RECURSIVE {RETRY_SQL} SELECT id, 'pending' AS new_state FROM st WHERE state = 'failed' UNION ALL SELECT id, 'created' FROM r JOIN st USING (id) WHERE state = 'complete'")
def c17_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _layered(spark, sf_dir)
    return graph.dependents(e, n.withColumn("state", F.when(F.col("id") % 97 == 5, "failed").when(F.col("id") % 11 == 0, "created").otherwise("complete")))


ROADS_SQL = "roads AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS src, l_suppkey + l_linenumber AS dst, l_quantity AS length, l_returnflag AS fc, l_linestatus AS ref FROM lineitem)"


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, each an edge of its part and a supplier's number."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("dst"), F.col("l_quantity").alias("length"), F.col("l_returnflag").alias("fc"), F.col("l_linestatus").alias("ref")
    )


@query("x7_shortest_path")
def x7_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = _roads(spark, sf_dir)
    return graph.shortest(roads, roads.agg(F.min("src").alias("id")).filter("id is not null"))


@query("graph_components")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_labels(_roads(spark, sf_dir))


@query("graph_decision_nodes", f"WITH {ROADS_SQL}, x AS (SELECT src AS node, fc, ref FROM roads UNION ALL SELECT dst, fc, ref FROM roads) SELECT node, count(*) AS degree, count(DISTINCT fc) AS classes, count(DISTINCT ref) AS refs, count(*) <> 2 OR count(DISTINCT fc) > 1 OR count(DISTINCT ref) > 1 AS decision FROM x GROUP BY node")
def graph_decision_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.decision_nodes(_roads(spark, sf_dir))


@query("graph_merge_chains")
def graph_merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_chains(_roads(spark, sf_dir))


# ---- rankings -------------------------------------------------------------


@query("w1_rank_results", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0) DESC, s_suppkey)::INT AS rank FROM supplier")
def w1_rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("metric", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return ranking.ranked(rows, ["s_nationkey"], "metric", "s_suppkey").select("s_suppkey", "rank")


@query("w2_top_candidates", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def w2_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select("s_suppkey", "s_acctbal")


@query("w3_improvement", "SELECT event_id, round(value / greatest(lag(value, 1, 50.0) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1.0), 6) AS improvement FROM events")
def w3_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.improvement(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("improvement", 6).alias("improvement"))


@query(
    "a43_convergence",
    """
    WITH r AS (SELECT user_id % 10 AS debate, day(ts)::INT AS round, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS score FROM events GROUP BY 1, 2), d AS (SELECT debate, round, abs(score - lag(score, 1, 50.0) OVER w) / greatest(lag(score, 1, 50.0) OVER w, 1.0) AS delta FROM r WINDOW w AS (PARTITION BY debate ORDER BY round))
    SELECT debate, round, round(delta, 6) AS delta, delta < 0.1 AS converged FROM d""",
)
def a43_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.functions.numeric import exact_mean

    rounds = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("debate"), F.dayofmonth("ts").alias("round")).agg(exact_mean(F.col("value")).alias("score"))
    return ranking.convergence(rounds, "debate", "round", "score").select("debate", "round", F.round("delta", 6).alias("delta"), "converged")


@query(
    "f23_split",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' WHEN place < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM r""",
)
def f23_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.7, "val": 0.15, "test": 0.15})


@query(
    "f24_classifier_metrics",
    """
    WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS tp, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS fp, count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS fn FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE, 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE, 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 9) AS f1 FROM c""",
)
def f24_classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").alias("actual"), (F.col("l_quantity") > 25).alias("predicted"))
    m = ranking.binary_metrics(rows, ["l_suppkey"])
    return m.select("l_suppkey", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# ---- text -----------------------------------------------------------------

WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


@query("f15_word_count", f"SELECT doc_id, len({WORDS_SQL})::INT AS words, length(text) AS chars FROM documents")
def f15_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query(
    "f11_chunks",
    f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), s AS (SELECT doc_id, w, list_concat([0], CASE WHEN len(w) > 100 THEN range(80, len(w), 100) ELSE [] END) AS starts FROM w WHERE len(w) > 0)
    SELECT doc_id, (i - 1)::INT AS chunk_no, starts[i]::INT AS start_word, least(len(w) - starts[i], 100)::INT AS words, md5(array_to_string(w[starts[i] + 1 : starts[i] + 100], ' ')) AS digest FROM s, unnest(range(1, len(starts) + 1)) t(i)""",
)
def f11_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(text.chunks(F.col("text"), 100, 20)))
    return rows.select("doc_id", "chunk_no", "start_word", "words", F.md5("text").alias("digest"))


SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
PHRASE_SQL = f"""
    pw AS (SELECT doc_id, source, list_transform({WORDS_SQL}, lambda x: regexp_replace(lower(x), '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS w FROM documents),
    pu AS (SELECT doc_id, source, unnest(w) AS phrase, unnest(range(1, len(w) + 1)) AS i FROM pw),
    pf AS (SELECT doc_id, source, phrase, min(i) AS i FROM pu WHERE length(phrase) > 5 GROUP BY ALL),
    pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM pf QUALIFY rank <= 5)"""


@query(
    "f12_summaries",
    f"""
    WITH {PHRASE_SQL}, s AS (SELECT doc_id, {SENTENCES_SQL.format(text="coalesce(text, '')")} AS s, text IS NULL AS none FROM documents), p AS (SELECT doc_id, string_agg(phrase, ',' ORDER BY rank) AS phrases FROM pr GROUP BY doc_id)
    SELECT doc_id, left(CASE len(s) WHEN 0 THEN '' WHEN 1 THEN s[1] ELSE s[1] || ' ' || s[len(s)] END, 300) AS summary, coalesce(phrases, '') AS phrases FROM s LEFT JOIN p USING (doc_id)""",
)
def f12_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_and_last(F.col("text")).alias("summary"), F.array_join(text.key_phrases(F.col("text")), ",").alias("phrases"))


def _category_sql(rows: str, keywords: dict[str, list[str]], bonus: dict[str, str] | None = None) -> str:
    """Category, score and confidence over ``rows(id, t)`` where t is lower case."""
    scores = ", ".join(" + ".join([f"contains(t, '{k}')::INT" for k in listed] + ([bonus[name]] if bonus and name in bonus else [])) + f" AS {name}" for name, listed in keywords.items())
    names = list(keywords)
    pick = " ".join(f"WHEN {n} = best THEN '{n}'" for n in names)
    return f"""
        WITH d AS ({rows}), s AS (SELECT id, {scores} FROM d), b AS (SELECT *, greatest({', '.join(names)}) AS best, {' + '.join(names)} AS total FROM s)
        SELECT id, CASE WHEN best <= 0 THEN 'other' {pick} END AS category, best::INT AS score, CASE WHEN best > 0 THEN round(best / total, 2) ELSE 0.5 END::DOUBLE AS confidence FROM b"""


def _categories(rows: DataFrame, key: str, c: Column) -> DataFrame:
    return rows.select(F.col(key).alias("id"), c.alias("c")).select("id", "c.category", "c.score", "c.confidence")


@query("f13_classify", _category_sql("SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents", text.DOCUMENT_KEYWORDS))
def f13_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(table(spark, sf_dir, "documents"), "doc_id", text.best_category(F.col("text"), text.DOCUMENT_KEYWORDS))


@query("f14_file_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'table' ELSE 'unknown' END AS kind FROM pages")
def f14_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.concat(F.lit("dir.x/page-"), "page_id", F.when(k == 0, ".PDF").when(k == 1, ".htm").when(k == 2, ".csv").otherwise(".xyz"))
    return table(spark, sf_dir, "pages").select("page_id", parsing.file_kind(path).alias("kind"))


@query("f16_page_metadata", r"""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')) AS title, regexp_extract(html, '<html[^>]*\blang=["'']([^"'']*)', 1, 'si') AS lang, len(regexp_extract_all(html, '<(h[1-3])[ >]', 1, 'si'))::INT AS headings, regexp_extract(html, '<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1, 'si') AS description, regexp_extract(html, '<link[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']*)', 1, 'si') AS canonical, regexp_extract(html, '<meta[^>]*property=["'']og:image["''][^>]*content=["'']([^"'']*)', 1, 'si') AS og_image FROM pages""")
def f16_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.page_metadata(F.col("html")).alias("m")).select("page_id", "m.title", "m.lang", "m.headings", "m.description", "m.canonical", "m.og_image")


_STEPS = [("(?is)<script\\b[^>]*>.*?</script\\s*>", " "), ("(?is)<style\\b[^>]*>.*?</style\\s*>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]*>", " ")]
PLAIN_SQL = "html"
for _pattern, _by in _STEPS:
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_pattern}', '{_by}', 'g')"
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PLAIN_SQL = f"replace({PLAIN_SQL}, '{_entity}', '{_plain}')"
PLAIN_SQL = f"trim(regexp_replace({PLAIN_SQL}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("f17_strip_tags", f"SELECT page_id, length({PLAIN_SQL}) AS chars, md5({PLAIN_SQL}) AS digest FROM pages")
def f17_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("chars"), F.md5(plain).alias("digest"))


LINKS_SQL = r"""
    links AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host, unnest(regexp_extract_all(html, '<a\b[^>]*\bhref=["'']([^"'']*)["'']', 1, 'si')) AS href FROM pages)"""


@query("f20_broken_links", f"WITH {LINKS_SQL}, k AS (SELECT *, lower(regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS to_host FROM links) SELECT page_id, count(*) FILTER (to_host <> '' AND to_host <> lower(host)) AS external_links, count(*) FILTER (href = '' OR href = '#' OR lower(href) LIKE 'javascript:%') AS broken_links FROM k GROUP BY page_id")
def f20_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.explode(text.links(F.col("html"))).alias("href"))
    to_host = text.host(F.col("href"))
    dead = (F.col("href") == "") | (F.col("href") == "#") | F.lower("href").startswith("javascript:")
    return rows.groupBy("page_id").agg(F.count_if((to_host != "") & (to_host != F.col("host"))).alias("external_links"), F.count_if(dead).alias("broken_links"))


@query("f20_links", f"WITH {LINKS_SQL} SELECT page_id, count(*) AS total_links, count(*) FILTER (href LIKE '/%' OR lower(regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) = lower(host)) AS internal_links FROM links GROUP BY page_id")
def f20_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.explode(text.links(F.col("html"))).alias("href"))
    inside = F.col("href").startswith("/") | (text.host(F.col("href")) == F.col("host"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("total_links"), F.count_if(inside).alias("internal_links"))


@query(
    "u2_distinct_urls",
    r"""
    WITH u AS (SELECT page_id, split_part(url, '#', 1) AS bare FROM pages), n AS (SELECT page_id, lower(regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) AS head, bare FROM u)
    SELECT head || regexp_replace(substr(bare, length(head) + 1), '/+$', '') AS url, min(page_id) AS first_page FROM n GROUP BY 1""",
)
def u2_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(parsing.url_key(F.col("url")).alias("url")).agg(F.min("page_id").alias("first_page"))


def _page_type_sql() -> str:
    path = r"trim(lower(regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')), '/')"
    named = " ".join("WHEN " + " OR ".join(f"contains(path, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in text.PATH_SIGNALS.items())
    rows = f"""SELECT id, t, CASE WHEN path IN ('', 'index', 'home') THEN 'homepage' {named} END AS named
        FROM (SELECT page_id AS id, lower(coalesce(html, '')) || chr(10) || lower(coalesce(url, '')) AS t, {path} AS path FROM pages)"""
    return _category_sql(rows, text.PAGE_SIGNALS, {n: f"(CASE WHEN named = '{n}' THEN {text.PATH_BONUS} ELSE 0 END)" for n in text.PAGE_SIGNALS})


@query("f18_page_type", _page_type_sql())
def f18_page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(table(spark, sf_dir, "pages"), "page_id", text.page_type(F.col("url"), F.col("html")))


@query("f19_page_summary", f"WITH p AS (SELECT page_id, {PLAIN_SQL} AS t FROM pages), s AS (SELECT page_id, list_filter({SENTENCES_SQL.format(text='t')}, lambda x: length(x) > 20) AS s FROM p) SELECT page_id, left(array_to_string(s[1:3], ' '), 500) AS summary FROM s")
def f19_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.opening(plain).alias("summary"))


@query("a38_site_report", f"WITH {LINKS_SQL}, n AS (SELECT page_id, host, count(*) AS links FROM links GROUP BY 1, 2) SELECT host, count(*) AS pages, sum(links)::BIGINT AS links, left(array_to_string(list_sort(list(page_id::VARCHAR)), ','), 2000) AS listed FROM n GROUP BY host")
def a38_site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.size(text.links(F.col("html"))).alias("links")).filter("links > 0")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("links").alias("links"))
    # an id and its comma take two characters or more, so 1,000 ids fill 2,000: the
    # first of the parts of a host, then of the host
    first = rows.select("host", F.col("page_id").cast("string").alias("id")).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["host", "_part"], ["host"]):
        first = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter("_rank <= 1001")
    listed = F.left(F.array_join(F.sort_array(F.collect_list("id")), ","), F.lit(2000))
    return totals.join(first.groupBy("host").agg(listed.alias("listed")), "host")


@query(
    "a39_merge_phrases",
    f"""
    WITH {PHRASE_SQL}, f AS (SELECT source, phrase, min((doc_id, rank)) AS seen FROM pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seen) AS n FROM f QUALIFY n <= 15)
    SELECT source, string_agg(phrase, ',' ORDER BY n) AS phrases FROM k GROUP BY source""",
)
def a39_merge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(text.key_phrases(F.col("text"))).alias("at", "phrase"))
    first = rows.groupBy("source", "phrase").agg(F.min(F.struct("doc_id", "at")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seen"))
    kept = first.withColumn("rank", rank).filter("rank <= 15")
    return kept.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]), ",").alias("phrases"))
