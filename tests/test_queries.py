"""Every registered query of the library against its SQL on the smallest tables."""

import math
import random
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return f"{round(float(value), 6) + 0.0:.6f}"
    return str(value)


def test_all_queries_are_registered():
    assert len(catalog.QUERIES) > 180 and set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    if not Path(SF).exists():
        pytest.skip("no tables here")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, (row[c] for c in columns))) for row in df.collect())
    if name in catalog.ORACLE:
        relation = oracle.sql(catalog.ORACLE[name])
        assert sorted(relation.columns) == columns
        order = [relation.columns.index(c) for c in columns]
        assert got == sorted(tuple(map(plain, (row[k] for k in order))) for row in relation.fetchall())
    else:
        assert got


def test_chains_are_merged_over_all_line_items(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, 1, rng.randrange(1, 700), rng.randrange(1, 700), float(rng.randrange(1, 50)), "N", "O") for k in range(1, 701)]
    columns = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    touching = {}
    for k, line, part, supplier, *_ in rows:
        for node in (part, supplier + line):
            touching.setdefault(node, []).append(k * 10 + line)
    length = {k * 10 + line: quantity for k, line, _, _, quantity, *_ in rows}
    root = {e: e for e in length}
    for edges in touching.values():
        if len(edges) == 2 and edges[0] != edges[1]:
            a, b = sorted(root[e] for e in edges)
            root = {e: a if r == b else r for e, r in root.items()}
    want = {}
    for e, r in root.items():
        members, total = want.get(r, (0, 0.0))
        want[r] = (members + 1, total + length[e])
    assert any(members > 2 for members, _ in want.values()) and max(want) > 4000
    got = catalog.QUERIES["graph_merge_chains"](spark, str(tmp_path)).collect()
    assert {r["logical"]: (r["members"], r["length"]) for r in got} == want


def roads(rng, n=400, nodes=300):
    return [(k, 1, rng.randrange(1, nodes), rng.randrange(1, nodes), float(rng.randrange(1, 50)), "N", "O") for k in range(1, n)]


ROAD_COLUMNS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"


def test_components_and_shortest_paths_over_all_line_items(spark, tmp_path):
    import heapq

    rows = roads(random.Random(5), 200)
    spark.createDataFrame(rows, ROAD_COLUMNS).write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for _, line, part, supplier, length, *_ in rows:
        near.setdefault(part, []).append((supplier + line, length))
        near.setdefault(supplier + line, []).append((part, length))
    root = {}
    for start in sorted(near):
        stack = [start] if start not in root else []
        while stack:
            node = stack.pop()
            if node not in root:
                root[node] = start
                stack += [to for to, _ in near[node]]
    assert {r["node"]: r["component"] for r in catalog.QUERIES["graph_components"](spark, str(tmp_path)).collect()} == root and len(set(root.values())) > 3
    best, heap = {}, [(0.0, min(r[2] for r in rows))]
    while heap:
        d, node = heapq.heappop(heap)
        if node not in best:
            best[node] = d
            for to, length in near[node]:
                heapq.heappush(heap, (d + length, to))
    assert {r["id"]: r["distance"] for r in catalog.QUERIES["x7_shortest_path"](spark, str(tmp_path)).collect()} == best


def test_breaker_states_over_all_events(spark, tmp_path):
    import datetime

    rng = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=k * 17), rng.randrange(4), "view", float(rng.choice([10, 50, 50, 50])), "{}") for k in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for user in range(4):
        mode, bad, good, since = "closed", 0, 0, None
        for _, ts, u, _, value, _ in rows:
            if u != user:
                continue
            at, was = int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000), mode
            if mode == "open" and at - since >= 60_000:
                mode, good = "half_open", 0
            bad, good = (bad + 1, 0) if value > 30 else (0, good + 1)
            if value > 30 and (mode == "half_open" or mode == "closed" and bad >= 5):
                mode, since = "open", at
            if value <= 30 and mode == "half_open" and good >= 2:
                mode = "closed"
            if mode != was:
                want.append((user, at, was, mode))
    got = sorted((r["handler"], r["at_ms"], r["was"], r["state"]) for r in catalog.QUERIES["st7_breaker_states"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(want) > 10
