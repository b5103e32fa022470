"""Operators on the inputs that a review found them to fail on."""

import collections
import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import graph, joins
from brindle.sources import files


def layered(spark, n):
    ids = spark.range(1, n + 1)
    edges = ids.select(F.floor(F.col("id") / 2).cast("long").alias("src"), F.col("id").alias("dst")).filter("src >= 1")
    return ids, edges.unionByName(ids.filter("id % 5 = 0 and id > 7").select((F.col("id") - 7).alias("src"), F.col("id").alias("dst"))).distinct()


def below(n, starts):
    seen, rest = set(starts), list(starts)
    while rest:
        i = rest.pop()
        for j in (2 * i, 2 * i + 1, *([i + 7] if (i + 7) % 5 == 0 else [])):
            if j <= n and j not in seen:
                seen.add(j)
                rest.append(j)
    return seen


def test_reachable_over_computed_edges(spark):
    """conditions on computed edges doubled from round to round, which
    2,000 nodes suffice to fill a driver with."""
    _, edges = layered(spark, 2000)
    out = graph.reachable(edges, spark.createDataFrame([(6,)], "id long"))
    assert {r["id"] for r in out.collect()} == below(2000, {6})


def test_dependents_over_computed_edges(spark):
    """the retry of a graph whose edges are computed from keys."""
    ids, edges = layered(spark, 2000)
    state = lambda i: "failed" if i % 97 == 5 else "created" if i % 11 == 0 else "complete"
    states = ids.withColumn("state", F.when(F.col("id") % 97 == 5, "failed").when(F.col("id") % 11 == 0, "created").otherwise("complete"))
    got = {(r["id"], r["new_state"]) for r in graph.dependents(edges, states).collect()}
    failed = {i for i in range(1, 2001) if state(i) == "failed"}
    assert got == {(i, "pending") for i in failed} | {(i, "created") for i in below(2000, failed) if state(i) == "complete"}


def test_fastq_files_are_read_in_splits(spark, tmp_path):
    """files were read whole, one task and one row each."""
    rng, want = random.Random(1), {}
    for name in "abc":
        quality = ["".join(chr(rng.randint(33, 73)) for _ in range(rng.randint(0, 30))) for _ in range(200)]
        (tmp_path / f"{name}.fastq").write_text("".join(f"@é{i}\n{'A' * len(q)}\n+\n{q}\n" for i, q in enumerate(quality)))
        bases = sum(map(len, quality))
        want[name] = (sum(q != "" for q in quality), bases, pytest.approx(sum(ord(c) - 33 for q in quality for c in q) / bases))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {r["file"][-7]: (r["reads"], r["bases"], r["mean_phred"]) for r in files.fastq_quality(spark, str(tmp_path)).collect()}
        assert got == want
        plan = files.fastq_quality(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "split(value" not in plan  # no row holds a file's lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_fallback_join_keeps_every_match(spark):
    """of several right rows with a key one was kept."""
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, k string")
    right = spark.createDataFrame([("xa", 1), ("xa", 2), ("a", 3), ("a", 4), ("b", 5), ("b", 6)], "rk string, v long")
    got = collections.Counter(tuple(r) for r in joins.fallback_join(left, right, "k", F.concat(F.lit("x"), F.col("k")), "rk").collect())
    assert got == collections.Counter([(1, "a", 1)] * 2 + [(1, "a", 2)] * 2 + [(2, "b", 5), (2, "b", 6), (3, "c", None), (4, None, None)])


def test_snap_looks_up_a_place_once(spark):
    """every copy of a point met every copy of a segment."""
    points = spark.range(60_000).select(F.col("id").alias("p"), F.lit(8.0).alias("lon"), (47 + F.col("id") % 2 / 10000).alias("lat"))
    segments = spark.range(5, 60_005).select(F.col("id").alias("e"), F.lit(7.99).alias("x1"), F.lit(47.0).alias("y1"), F.lit(8.01).alias("x2"), F.lit(47.0).alias("y2"))
    got = joins.snap(points, segments, "p", "e")
    assert {tuple(r) for r in got.groupBy("e", F.round("metres", 1)).count().collect()} == {(5, 0.0, 30_000), (5, 11.1, 30_000)}


def test_pairs_of_one_group_are_dealt_to_many_tasks(spark):
    """a group was paired by one task."""
    rows = spark.createDataFrame([(1, i) for i in range(1300)], "g long, id long")
    pairs = joins.unordered_pairs(rows, "g", "id", block=100)
    got = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.spark_partition_id().alias("p"))
    r = got.agg(F.count(F.lit(1)), F.count_distinct("a", "b"), F.count_if(F.col("a") >= F.col("b")), F.count_distinct("p")).first()
    assert tuple(r)[:3] == (1300 * 1299 // 2, 1300 * 1299 // 2, 0) and r[3] > 30


def metres(a, b):
    x, y = math.radians(a[0] - b[0]) / 2, math.radians(a[1] - b[1]) / 2
    h = math.sin(y) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(x) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_sampled_pairs_with_few_far_ones(spark):
    """groups with many far pairs, with two, and with none."""
    rng = random.Random(2)
    rows = [("far", i, rng.uniform(-170, 170), rng.uniform(-60, 60)) for i in range(200)] + [("near", i, rng.random() / 10, 0.0) for i in range(200)]
    rows += [("near", 200, 50.0, 0.0), ("none", 1, 0.0, 0.0), ("none", 2, 0.1, 0.0)]
    want = set()
    for g in ("far", "near", "none"):
        group = [r for r in rows if r[0] == g]
        pairs = [(r[1], q[1]) for r, q in itertools.combinations(group, 2) if metres(r[2:], q[2:]) >= 150_000]
        want |= {(g, *p) for p in sorted(pairs, key=lambda p: hashlib.md5(f"{p[0]}-{p[1]}".encode()).hexdigest())[:3]}
    out = joins.sampled_pairs(spark.createDataFrame(rows, "g string, id long, lon double, lat double"), "g", "id", 150_000.0, 3)
    assert {(r["g"], r["a"]["id"], r["b"]["id"]) for r in out.collect()} == want and out.select("a.*").columns == ["g", "id", "lon", "lat"]


def test_nearest_looks_further_only_where_nothing_is_near(spark):
    """F8, F9, F11: ties to the millimetre, copies, and places far from all."""
    rng = random.Random(3)
    right = [(i, round(rng.uniform(-180, 180), 2), round(rng.uniform(-80, 80), 2)) for i in range(10, 600)] + [(i, 5.0, 5.0) for i in range(600, 700)]
    right += [(5000, 20.1, 40.0), (4000, 20.5, 40.0)]
    left = [(i, round(rng.uniform(-180, 180), 2), round(rng.uniform(-80, 80), 2)) for i in range(300)] + [(i, 5.01, 5.0) for i in range(300, 400)] + [(400, 20.3, 40.0), (401, None, 1.0)]
    got = joins.nearest(spark.createDataFrame(left, "l long, lon double, lat double"), spark.createDataFrame(right, "r long, lon double, lat double"), "l", "r", 500_000.0)
    got = {r["l"]: (r["r"], round(r["metres"], 3)) for r in got.collect()}
    for key, *at in left:
        near = [] if None in at else [(round(d, 3), k) for k, *to in right if (d := metres(at, to)) <= 500_000]
        assert got[key] == ((min(near)[1], pytest.approx(min(near)[0], abs=0.01)) if near else (None, -1.0))
    assert got[400][0] == 4000


def test_first_containing_by_cells_held_whole(spark):
    """triangles, squares and copies against a test of every pair."""
    rng = random.Random(4)
    rings = []
    for k in range(120):
        x, y, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(1, 30)
        turn = [rng.uniform(0, 6.28) for _ in range(3)] if k % 2 else [0.785, 2.356, 3.927, 5.498]
        rings.append((k, [(x + r * math.cos(t), y + r * math.sin(t)) for t in sorted(turn)]))
    rings += [(k + 1000, ring) for k, ring in rings]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(1500)]

    def inside(x, y, ring):
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    want = {i: min(k for k, ring in rings if inside(x, y, ring)) for i, x, y in points if any(inside(x, y, ring) for _, ring in rings)}
    polygons = spark.createDataFrame(rings, "k long, ring array<struct<lon:double,lat:double>>")
    got = joins.first_containing(spark.createDataFrame(points, "p long, lon double, lat double"), polygons, "p", "k", cell=10.0)
    assert {r["p"]: r["k"] for r in got.collect()} == want


def test_decision_nodes_count_kinds_of_ends_first(spark):
    """every end was held three times to count distinct values."""
    edges = spark.range(20_000).select(F.lit(1).alias("src"), (2 + F.col("id") % 2).alias("dst"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("fc"), (F.col("id") % 2).alias("ref"))
    out = graph.decision_nodes(edges)
    assert {tuple(r) for r in out.collect()} == {(1, 20_000, 2, 2, True), (2, 10_000, 2, 1, True), (3, 10_000, 2, 1, True)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")


def test_most_edges_are_offered_a_few_times(spark, monkeypatch):
    """F16: all edges were read and shuffled in every round, and an edge without
    an end added a row in each."""
    import heapq

    rng = random.Random(16)
    edges = [(rng.randrange(300), 300 + rng.randrange(40), rng.choice([0.0, *map(float, range(1, 51))])) for _ in range(4000)]
    edges += [(1000, 1001, 3.0), (5, 2000, 90.0), (2000, 2001, 1.0)]
    near = collections.defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    want, heap = {}, [(0.0, 5)]
    while heap:
        d, k = heapq.heappop(heap)
        if k not in want:
            want[k] = d
            for to, w in near[k]:
                heapq.heappush(heap, (d + w, to))
    rounds, plain = [], graph._offered
    monkeypatch.setattr(graph, "_offered", lambda best, part, which, *rest: rounds.append(which) or plain(best, part, which, *rest))
    table = spark.createDataFrame([*edges, (5, None, 1.0), (None, 6, 1.0), (5, 3000, None), (3000, 3001, 1.0)], "src long, dst long, length double")
    starts = spark.createDataFrame([(5,)], "id long")
    for few in (graph._FEW, 0):
        monkeypatch.setattr(graph, "_FEW", few)
        rounds.clear()
        rows = [tuple(r) for r in graph.shortest(table, starts).collect()]
        assert len(rows) == len(set(rows)) and dict(rows) == want | {3000: None}
        assert rounds.count("_due") <= 3 < rounds.count("_fell")
    assert [tuple(r) for r in graph.shortest(table.limit(0), starts).collect()] == [(5, 0.0)]
