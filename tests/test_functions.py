"""Single values and edge rows, many of them worked out by hand."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import expressions as ex
from brindle.functions import geo, parsing, text
from brindle.operators import climate, genomics, graph, joins, maps, quality, ranking, risk, routing, stations


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_expression_semantics(spark):
    lit = F.lit
    assert one(spark, ex.join_text((lit(True), "boolean"), (lit(None).cast("string"), "string"), (lit(2.0), "double"), (lit(1), "int"))) == "True2.01"
    assert one(spark, ex.divide(lit(7), lit(2))) == 3.5
    assert [one(spark, ex.modulo(lit(a), lit(b))) for a, b in ((-7, 3), (7, -3), (7, 3), (-6, 3))] == [2, -2, 1, 0]
    assert one(spark, ex.same(lit(None), lit(None))) is True and one(spark, ex.same(lit(None), lit(1))) is False
    assert [one(spark, ex.truthy(lit(v), k)) for v, k in (("", "string"), ("a", "string"), (0, "int"), (False, "boolean"))] == [False, True, False, False]
    assert one(spark, ex.item(F.array(lit(1), lit(2), lit(3)), lit(-1))) == 3
    for bad in (ex.divide(lit(1), lit(0)), ex.item(F.array(lit(1)), lit(1)), ex.ordered(lit(None).cast("int"), lit(1), "<"), ex.entry(F.create_map(lit("a"), lit(1)), lit("b"))):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, bad)
    given = F.create_map(lit("a"), lit(None).cast("string"))
    assert one(spark, ex.with_defaults(given, {"a": lit("x"), "b": lit("y")})) == {"a": None, "b": "y"}


def test_parsing(spark):
    cases = {"1234": 1234, "1,234": 1234, "1.234": 1234, "~1000": 1000, "≈ 5 000": 5000, "300+": 300, "-5": -5, "": None, "none": None}
    for value, want in cases.items():
        assert one(spark, parsing.population(F.lit(value))) == want, value
    assert [one(spark, parsing.speed_kmh(F.lit(v))) for v in ("50", "30 mph", "walk")] == [50, 48, None]
    assert one(spark, parsing.metres(F.lit("40 ft"))) == pytest.approx(12.192)
    assert [one(spark, parsing.file_size(F.lit(v))) for v in (5, 2048, 3 * 1024**2)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(spark, parsing.backoff_ms(F.lit(100))) == 300_000
    assert one(spark, parsing.url_key(F.lit("HTTPS://Ex.COM/a/b/#top"))) == "https://ex.com/a/b"


def test_geometry(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(111_194.9, abs=0.1)
    line = F.array(point(0, 0), point(1, 0), point(1, 1))
    assert one(spark, geo.line_length(line)) == pytest.approx(2 * 111_194.9, abs=0.3)
    assert one(spark, geo.line_length(F.slice(line, 1, 1))) == 0.0
    square = F.array(point(0, 0), point(2, 0), point(2, 2), point(0, 2))
    assert one(spark, geo.contains(square, F.lit(1.0), F.lit(1.0))) and not one(spark, geo.contains(square, F.lit(3.0), F.lit(1.0)))
    climb = one(spark, geo.climb(F.array(*map(F.lit, (1.0, 5.0, 3.0, 3.0, 4.0)))))
    assert (climb["gain"], climb["loss"]) == (5.0, 2.0)


def test_near_pairs_match_brute_force(spark):
    import random

    rng = random.Random(4)
    spots = [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(250)] + [(300, 179.9, 10.0), (301, -179.9, 10.0), (302, 10.0, 89.5), (303, -170.0, 89.4), (304, None, 1.0)]
    a = spark.createDataFrame(spots, "a long, lon double, lat double")
    b = a.withColumnRenamed("a", "b")
    for metres in (300_000.0, 1_500_000.0):
        got = {(r["l"]["a"], r["r"]["b"]) for r in joins.pairs_within(a, b, metres).collect()}
        distance = geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
        want = {(r[0], r[1]) for r in a.alias("a").crossJoin(b.alias("b")).filter(distance <= metres).select("a.a", "b.b").collect()}
        assert got == want and (300, 301) in got and (302, 303) in got


def test_trend_degenerate_cases(spark):
    rows = [("line", x, float(2 * x)) for x in (1, 2, 3, 4)] + [("one", 3, 7.0), ("flat", 1, 2.0), ("flat", 1, 4.0), ("none", 1, None)]
    got = {r["k"]: (r["slope"], r["intercept"], r["n"]) for r in climate.trend(spark.createDataFrame(rows, "k string, x int, y double"), ["k"], "x", "y").collect()}
    assert got["line"] == pytest.approx((2.0, 0.0, 4)) and got["one"] == (0.0, 7.0, 1) and got["flat"] == (0.0, 3.0, 2) and got["none"] == (0.0, 0.0, 0)


def test_climate_thresholds_are_strict(spark):
    rows = [(1, 35.0, 0.0, 0.0), (1, 36.0, -3.0, 1.0), (1, None, 5.0, None)]
    r = climate.period_climate(spark.createDataFrame(rows, "k int, tmax double, tmin double, prcp double"), ["k"]).first()
    assert (r["hot_days"], r["frost_days"], r["precip_days"], r["temp_mean"], r["obs_days"]) == (1, 1, 1, 17.0, 3)


def test_tail_risk(spark):
    rows = [(1, float(v)) for v in range(-500, 500)]
    df = spark.createDataFrame(rows, "k int, v double")
    r = risk.tail_risk(df, ["k"], "v", 0.95).first()
    assert r["var"] == -450.0 and r["cvar"] == pytest.approx(-475.0)
    import numpy as np

    m = [[1.0, 0.3, 0.1], [0.3, 1.0, 0.5], [0.1, 0.5, 1.0]]
    lower = risk.cholesky(m)
    assert np.allclose(lower @ lower.T, m, atol=1e-10)


def test_sensor_rules(spark):
    lit = lambda v: F.lit(float(v))
    b = one(spark, quality.threshold_breach(lit(-45), lit(-10), lit(50), lit(-40), lit(80)))
    assert tuple(b) == ("critical", "critical_low", 5.0)
    assert one(spark, quality.threshold_breach(lit(50), lit(-10), lit(50), lit(-40), lit(80)))["breached"] == "high"
    assert tuple(one(spark, quality.calibrated(lit(20), lit(1.1), lit(1), lit(-50), lit(100)))) == (pytest.approx(23.0), True)
    assert one(spark, quality.alert_priority(F.lit("odd"))) == 3


def test_routing_without_a_case_raises(spark):
    df = spark.range(3)
    same = lambda d: d
    assert routing.route(df, [(F.col("id") >= 0, same), (F.col("id") == 1, same)]).count() == 4
    with pytest.raises(Exception, match="no case matched"):
        routing.route(df, [(F.col("id") == 1, same)]).collect()


def test_scaling_and_splits(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 10.0)], "id int, a double, b double")
    got = {r["id"]: (r["norm_a"], r["norm_b"]) for r in maps.rescale(df, ["a", "b"], []).collect()}
    assert got == {1: (0.5, 0.0), 2: (0.5, 1.0)}
    parts = ranking.split(spark.range(2001), "id", {"train": 0.7, "val": 0.15, "test": 0.15})
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 1400, "val": 300, "test": 301}
    numbered = ranking.numbered(spark.range(500).repartition(7), "id").collect()
    assert sorted(r["place"] for r in numbered) == list(range(500)) and {r["rows"] for r in numbered} == {500}


def test_text(spark):
    assert one(spark, text.word_count(F.lit("  a b\n c "))) == 3 and one(spark, text.word_count(F.lit(None).cast("string"))) == 0
    chunks = one(spark, text.chunks(F.lit(" ".join(map(str, range(25)))), 10, 3))
    assert [(c["start_word"], c["words"]) for c in chunks] == [(0, 10), (7, 10), (17, 8)]
    assert one(spark, text.strip_tags(F.lit("<style>x</style><p>a &amp; b<!-- c --></p>"))) == "a & b"
    many = "w " * 40_000
    assert len(one(spark, text.chunks(F.lit(many), 10, 3))) == 4001


def test_formats_of_times(spark):
    cases = [(0, "\u2014"), (None, "\u2014"), (5000, "5s"), (90_000, "1m 30s"), (3_660_000, "1h 1m"), (59_999, "59s")]
    assert [one(spark, parsing.duration(F.lit(ms).cast("long"))) for ms, _ in cases] == [want for _, want in cases]
    assert [one(spark, parsing.duration_long(F.lit(ms).cast("long"))) for ms in (0, 61_000, 90_061_000)] == ["\u2014", "0:01:01", "1:01:01:01"]
    now = 10**12
    cases = [(45_000, "45s ago"), (-5000, "just now"), (120_000, "2m ago"), (3_600_000, "1h ago"), (11_100_000, "3h 5m ago"), (93_600_000, "1d 2h ago"), (86_400_000, "1d ago")]
    assert [one(spark, parsing.ago(F.lit(now - d), F.lit(now))) for d, _ in cases] == [want for _, want in cases]


def test_categories_count_each_keyword_once(spark):
    got = one(spark, text.best_category(F.lit("Contract contract agreement with a patient"), text.DOCUMENT_KEYWORDS))
    assert tuple(got) == ("legal", 2, 0.67)
    assert tuple(one(spark, text.best_category(F.lit("xyzzy"), text.DOCUMENT_KEYWORDS))) == ("other", 0, 0.5)
    assert one(spark, text.page_type(F.lit("https://e.com/"), F.lit("<p>x</p>")))["category"] == "homepage"
    assert tuple(one(spark, text.page_type(F.lit("https://e.com/blog/1"), F.lit("<article>by author</article>")))) == ("blog", 6, 1.0)
    assert one(spark, text.page_type(F.lit("https://e.com/zz"), F.lit("404 not found, oops")))["category"] == "error"


def test_classes_of_features(spark):
    def tags(**given):
        return spark.range(1).select(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]).alias("tags"))

    cases = [({"boundary": "national_park"}, "national"), ({"protect_class": "2"}, "national"), ({"designation": "State_Park"}, "state"), ({"designation": "a provincial park"}, "state"), ({"protect_class": "4"}, "protected_area"),
             ({"leisure": "nature_reserve"}, "nature_reserve"), ({"protect_class": "1a"}, "nature_reserve"), ({"boundary": "protected_area"}, "protected_area"), ({"leisure": "park"}, "park"), ({"x": "y"}, "protected_area")]
    assert [tags(**t).select(maps.park_class()).first()[0] for t, _ in cases] == [want for _, want in cases]
    assert tags(highway="cycleway").select(maps.road_class()).first()[0] == "path" and tags(highway="x").select(maps.road_class()).first()[0] == "other"
    assert tags(shop="x").select(maps.amenity_class()).first()[0] == "shopping" and tags(amenity="pub", shop="x").select(maps.amenity_class()).first()[0] == "food"
    assert tags(building="yes", office="x").select(maps.building_class()).first()[0] == "office"


def test_road_scores(spark):
    no = F.lit(False)
    score = lambda fc, ref="", structure=no, unpaved=no, restricted=no: one(spark, maps.class_score(F.lit(fc), F.lit(ref), structure, unpaved, restricted))
    assert score("primary") == 0.75 and score("primary", "M1") == pytest.approx(0.80) and score("tertiary", structure=F.lit(True)) == pytest.approx(0.48)
    assert score("secondary", unpaved=F.lit(True)) == pytest.approx(0.50) and score("secondary", restricted=F.lit(True)) == pytest.approx(0.45) and score("path", restricted=F.lit(True)) == 0.0
    assert [one(spark, maps.density_factor(F.lit(float(km)), F.lit(1.0))) for km in (0.1, 0.2, 1.0, 5.0, 20.0)] == [1.3, 1.0, 0.6, 0.4, 0.4]


def test_rings_need_radii_in_range(spark):
    rows = [("few", 20.0, 1)] * 9 + [("ring", 20.0, 1)] * 12 + [("inner", 10.0, 1)] * 12 + [("outer", 99.0, 1)] * 12
    df = spark.createDataFrame(rows, "k string, r double, v int")
    got = maps.ring_test(df, ["k"], "r", "v", 0.3, F.min(F.lit(10.0)), F.min(F.lit(50.0))).collect()
    assert {r["k"]: r["ring"] for r in got} == {"few": False, "ring": True, "inner": False, "outer": False}


def test_greedy_budget_matches_a_plain_loop(spark):
    import random

    rng = random.Random(6)
    rows = [(z, c, k, float(rng.randint(1, 40)), float(rng.randint(0, 9)), 60.0, 100.0 if c == 2 else 0.0) for k, (z, c) in enumerate((z, c) for z in (2, 3) for c in (1, 2, 3) for _ in range(25))]
    df = spark.createDataFrame(rows, "zoom int, cell long, edge_id long, km double, score double, budget_km double, floor_km double")
    want = set()
    for z, c in {(r[0], r[1]) for r in rows}:
        used, refused = 0.0, []
        mine = sorted((r for r in rows if r[:2] == (z, c)), key=lambda r: (-r[4], r[2]))
        for r in mine:
            if used + r[3] <= r[5]:
                used += r[3]
                want.add(r[2])
            else:
                refused.append(r)
        for r in refused:
            if used >= r[6]:
                break
            used += r[3]
            want.add(r[2])
    assert {r["edge_id"] for r in maps.greedy_budget(df, "zoom", "cell").collect()} == want


def test_graph_layers_cycles_and_retry(spark):
    nodes = spark.range(1, 8)
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)], "src long, dst long")
    assert {r["id"]: r["level"] for r in graph.layers(nodes, edges).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 1}
    with pytest.raises(ValueError, match="cycle"):
        graph.layers(nodes, edges.union(spark.createDataFrame([(4, 2)], "src long, dst long")))
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "id long, parent long"))
    states = spark.createDataFrame([(1, "complete"), (2, "failed"), (3, "complete"), (4, "created"), (7, "complete")], "id long, state string")
    assert {tuple(r) for r in graph.dependents(edges, states).collect()} == {(2, "pending"), (3, "created")}


def test_medians_and_hulls(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(k, float(rng.choice([rng.randint(0, 9), rng.uniform(0, 1)]))) for k in ("a", "b") for _ in range(501 if k == "a" else 400)] + [("c", 4.0)]
    got = {r["k"]: r["median"] for r in maps.medians(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    assert got == {k: statistics.median(v for g, v in rows if g == k) for k in "abc"}
    points = [("s", float(x), float(y)) for x in range(5) for y in range(5)] + [("p", 1.0, 1.0), ("p", 2.0, 2.0), ("p", None, 1.0)]
    hull = joins.convex_hull(spark.createDataFrame(points, "k string, lon double, lat double"), "k", salts=4).orderBy("k", "corner").collect()
    assert [(r["lon"], r["lat"]) for r in hull if r["k"] == "s"] == [(0, 0), (4, 0), (4, 4), (0, 4)] and [(r["lon"], r["lat"]) for r in hull if r["k"] == "p"] == [(1, 1), (2, 2)]


def test_references_raise(spark):
    inputs = F.create_map(F.lit("a"), F.lit('{"b": {"c": "x"}, "n": null}'), F.lit("z"), F.lit(None).cast("string"))
    assert one(spark, ex.input_value(inputs, "a", "b", "c")) == "x" and one(spark, ex.input_value(inputs, "z")) is None
    for bad in (ex.input_value(inputs, "q"), ex.input_value(inputs, "a", "b", "d"), ex.input_value(inputs, "a", "n", "d"), ex.input_value(inputs, "z", "b"), ex.step_value(inputs, "s", "z"), ex.step_value(inputs, "s", "q")):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, bad)


def test_stations_and_mutations(spark):
    assert one(spark, stations.in_state(F.lit(30.0), F.lit(-100.0), F.lit("tx"))) and not one(spark, stations.in_state(F.lit(30.0), F.lit(-100.0), F.lit("ZZ"))) and not one(spark, stations.in_state(F.lit(None).cast("double"), F.lit(-100.0), F.lit("TX")))
    m = one(spark, genomics.mutation(F.lit("RT"), F.lit(184), F.lit("M"), F.lit("V")))
    assert tuple(m) == (True, False, "NRTI", "M184V")
    assert tuple(one(spark, genomics.mutation(F.lit("PR"), F.lit(1), F.lit("G"), F.lit("R")))) == (False, True, "PI", "G1R")
    v = one(spark, genomics.read_verdict(F.lit(25.0), F.lit(900), F.lit(10)))
    assert tuple(v) == (90, False, "low quality (25.0 < 30); low depth (90 < 100)")
