"""Graphs as vertex and edge tables, walked by joins one layer at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.lineage import cut as _cut
from brindle.operators.lineage import store as _store


def layers(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Topological level of each node: 0 without needs, else one more than the
    highest need. ``edges(src, dst)``: dst needs src. Layers are peeled off by
    the number of needs still open, so each edge is used once; what is left
    when no node is free lies on or behind a cycle, which raises."""
    pairs = _cut(edges.select("src", "dst").distinct())
    both = nodes.select(node).unionByName(pairs.select(F.col("src").alias(node))).unionByName(pairs.select(F.col("dst").alias(node))).distinct()
    needs = pairs.groupBy(F.col("dst").alias(node)).agg(F.count(F.lit(1)).alias("open"))
    waiting = _cut(both.join(needs, node, "left").select(node, F.coalesce("open", F.lit(0)).alias("open")))
    level, done = 0, None
    while not waiting.isEmpty():
        free = _cut(waiting.filter("open = 0").select(node, F.lit(level).alias("level")))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        # layers are as large as the graph in sum, so none goes through the driver
        closed = pairs.join(free.select(F.col(node).alias("src")).hint("merge"), "src").groupBy(F.col("dst").alias(node)).agg(F.count(F.lit(1)).alias("closed"))
        waiting = waiting.filter("open > 0").join(closed.hint("merge"), node, "left")
        waiting = _cut(waiting.select(node, (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        level += 1
        if level % 50 == 0:
            done = _cut(done)
    if done is None:
        return nodes.select(node, F.lit(0).alias("level"))
    return done.join(nodes.select(node), node, "left_semi")


def depths(parents: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """Depth of each node of a forest; roots and orphans are at 0. Nodes on or
    below a cycle of parents have none, which raises."""
    known = parents.select(F.col(node).alias(parent)).distinct()
    rows = _cut(parents.join(known.withColumn("_known", F.lit(True)), parent, "left"))
    level = _cut(rows.filter("_known is null").select(node, F.lit(0).alias("depth")))
    children = rows.filter("_known").select(node, parent)
    done, depth, placed = level, 0, level.count()
    while True:
        depth += 1
        level = _cut(children.join(level.select(F.col(node).alias(parent)), parent).select(node, F.lit(depth).alias("depth")))
        n = level.count()
        if not n:
            break
        placed += n
        done = done.unionByName(level)
        if depth % 50 == 0:
            done = _cut(done)
    if placed < rows.count():
        raise ValueError("the parents have a cycle")
    return done


def dependents(edges: DataFrame, states: DataFrame, node: str = "id") -> DataFrame:
    """What a retry starts again: failed nodes as pending, and all that need
    them, directly or not, as created, unless they never began.
    ``states(id, state)``; one row per node whose state changes."""
    failed = states.filter("state = 'failed'").select(node)
    behind = reachable(edges, failed, node).filter("hops > 0").select(node)
    again = behind.join(failed, node, "left_anti").join(states.filter("state <> 'created'"), node).select(node, F.lit("created").alias("new_state"))
    return failed.distinct().select(node, F.lit("pending").alias("new_state")).unionByName(again)


def reachable(edges: DataFrame, starts: DataFrame, node: str = "id") -> DataFrame:
    """Nodes that can be reached from the starts (included), with hop counts.

    Edges are cut first and nodes are stored, so that a round's plan is a join
    of three tables and knows nothing of the rounds before it."""
    pairs = _cut(edges.select("src", "dst").distinct())
    seen = _store(starts.select(node, F.lit(0).alias("hops")).distinct())
    frontier, hops = seen, 0
    while True:
        hops += 1
        nexts = pairs.join(frontier.select(F.col(node).alias("src")), "src").select(F.col("dst").alias(node)).distinct()
        frontier = _store(nexts.join(seen, node, "left_anti").select(node, F.lit(hops).alias("hops")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hops % 20 == 0:
            seen = _store(seen)


#: Of nodes that send on their distance, so many at most are broadcast.
_FEW = 100_000


def shortest(edges: DataFrame, starts: DataFrame, node: str = "id", weight: str = "length", light: float = 0.125) -> DataFrame:
    """Least summed weight from any start, edges used both ways: only nodes
    whose distance fell send it on. The ``light`` share of the edges is followed
    until nothing falls before the other edges are offered, all at once, what
    fell since they last were; so most edges are read a few times and not in
    every round. Edges without an end lead nowhere; a node that only edges
    without a weight lead to has a null distance."""
    both = edges.select("src", "dst", weight).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight))
    both = _store(both.filter("src is not null and dst is not null"))
    most = both.agg(F.percentile_approx(weight, light).alias("most")).first()["most"]
    is_light = F.coalesce(F.col(weight) <= F.lit(most), F.lit(False))
    near, far = _store(both.filter(is_light)), both.filter(~is_light)
    # _fell: in the last round; _due: since the far edges were offered last
    best = _store(starts.select(node, F.lit(0.0).alias("distance"), F.lit(True).alias("_fell"), F.lit(True).alias("_due")).distinct())
    while True:
        while n := best.filter("_fell").count():
            best = _offered(best, near, "_fell", n, node, weight)
        n = best.filter("_due").count()
        if not n:
            return best.select(node, "distance")
        best = _offered(best, far, "_due", n, node, weight)


def _offered(best: DataFrame, edges: DataFrame, which: str, n: int, node: str, weight: str) -> DataFrame:
    """``best`` after the ``n`` nodes of ``which`` have sent on their distance."""
    senders = best.filter(which).select(F.col(node).alias("src"), "distance")
    offers = edges.join(F.broadcast(senders) if n <= _FEW else senders, "src").select(F.col("dst").alias(node), (F.col("distance") + F.col(weight)).alias("_offer"))
    due = F.col("_due") if which == "_fell" else F.lit(False)
    known = best.select(node, F.lit(None).cast("double").alias("_offer"), "distance", due.alias("_due"))
    met = known.unionByName(offers, allowMissingColumns=True).groupBy(node).agg(F.min("distance").alias("distance"), F.min("_offer").alias("_offer"), F.max(F.coalesce("_due", F.lit(False))).alias("_due"))
    better = F.col("_offer").isNotNull() & (F.col("distance").isNull() | (F.col("_offer") < F.col("distance")))
    return _store(met.select(node, F.when(better, F.col("_offer")).otherwise(F.col("distance")).alias("distance"), better.alias("_fell"), (better | F.col("_due")).alias("_due")))


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by label exchange with
    pointer jumping, so that long paths halve in each round."""
    both = _cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = _cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    while True:
        offers = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_offer"))
        jumps = labels.select(F.col("node").alias("component"), F.col("component").alias("_jump"))
        nexts = labels.join(offers, "node").join(jumps, "component")
        nexts = _cut(nexts.select("node", F.least("component", "_offer", "_jump").alias("component"), F.col("component").alias("_was")))
        labels = nexts.select("node", "component")
        if nexts.filter("component <> _was").isEmpty():
            return labels


def decision_nodes(edges: DataFrame) -> DataFrame:
    """Nodes where a road network forks, ends or changes class or name."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "fc", "ref")
    # few kinds of ends meet at a node, so they are counted before distinct values are
    kinds = ends.groupBy("node", "fc", "ref").agg(F.count(F.lit(1)).alias("_ends"))
    stats = kinds.groupBy("node").agg(F.sum("_ends").alias("degree"), F.count_distinct("fc").alias("classes"), F.count_distinct("ref").alias("refs"))
    return stats.withColumn("decision", (F.col("degree") != 2) | (F.col("classes") > 1) | (F.col("refs") > 1))


def merge_chains(edges: DataFrame) -> DataFrame:
    """Edges that meet at nodes without a decision become one logical edge:
    edge_id of the smallest member, number of members and summed length."""
    plain = decision_nodes(edges).filter("not decision").select("node")
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node")).join(plain, "node")
    links = ends.groupBy("node").agg(F.min("edge_id").alias("src"), F.max("edge_id").alias("dst")).filter("src <> dst").select("src", "dst")
    chains = component_labels(links)
    merged = edges.join(chains.withColumnRenamed("node", "edge_id"), "edge_id", "left").withColumn("logical", F.coalesce("component", "edge_id"))
    return merged.groupBy("logical").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("length").cast("decimal(18,4)")).cast("double").alias("length"))
