"""Operators on hand-made rows whose answers follow from their rules."""

import math

from pyspark.sql import functions as F

from roadspark.operators import graph, mapbuild, signals, spatial, telemetry


def ways(spark, rows):
    """(way_id, highway, extra tags, nodes)"""
    data = [(w, k, {"highway": h} | t, n) for k, (w, h, t, n) in enumerate(rows)]
    return spark.createDataFrame(data, "way_id string, ord long, tags map<string,string>, nodes array<string>")


def nodes(spark, **at):
    return spark.createDataFrame([(k, float(x), float(y), {}) for k, (x, y) in at.items()], "node_id string, x double, y double, tags map<string,string>")


def test_t_junction_splits_the_through_road(spark):
    w = ways(spark, [("a", "primary", {}, ["1", "2", "3"]), ("b", "residential", {}, ["2", "4"]), ("f", "footway", {}, ["1", "3", "4"])])
    got = {r.way_id: r.nodes for r in mapbuild.split_ways(w).collect()}
    assert got == {"a": ["1", "2"], "a_s1": ["2", "3"], "b": ["2", "4"], "f": ["1", "3", "4"]}


def test_bridge_is_no_junction(spark):
    w = ways(spark, [("a", "primary", {}, ["1", "2"]), ("b", "primary", {"bridge": "yes"}, ["2", "3"])])
    assert {(r.node_id, r.layer): r.ends for r in mapbuild.junction_endpoints(w).collect()}[("2", 0)] == 1


def test_trim_skips_short_ways(spark):
    n = nodes(spark, a=(0, 0), b=(4, 0), c=(30, 0), d=(4, 9), e=(-9, 0))
    w = ways(spark, [("s", "primary", {}, ["a", "b"]), ("l", "primary", {}, ["b", "c"]), ("u", "primary", {}, ["b", "d"]), ("v", "primary", {}, ["a", "e"])])
    length = {r.way_id: r.trimmed_len for r in mapbuild.trim_ways(w, n).select("way_id", "trimmed_len").distinct().collect()}
    assert length == {"s": 4.0, "l": 23.5, "u": 6.5, "v": 6.5}


def test_nearest_node_beyond_the_first_cell(spark):
    n = nodes(spark, far=(5000, 0), farther=(9000, 0))
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert [(r.node_id, r.dist_m) for r in spatial.nearest_node(p, n).collect()] == [("far", 5000.0)]


def test_divided_way_has_twins_inside(spark):
    n = nodes(spark, a=(0, 0), b=(100, 0), c=(200, 0))
    w = ways(spark, [("d", "primary", {"divider": "yes", "maxspeed": "36"}, ["a", "b", "c"])])
    got = {(r.src, r.dst, r.weight_sec) for r in graph.routing_edges(n, w).collect()}
    assert got == {("a", "b#fwd", 10.0), ("b#fwd", "c", 10.0), ("c", "b#bwd", 10.0), ("b#bwd", "a", 10.0)}


def test_shortest_paths_against_a_plain_loop(spark):
    edges = [(f"n{a}", f"n{b}", float(1 + (a * 7 + b * 3) % 11)) for a in range(12) for b in range(12) if a != b and (a * 5 + b) % 4 == 0]
    od = [(k, f"n{k % 12}", f"n{(k * 5 + 2) % 12}") for k in range(20)]
    dist = {}
    for s in {o for _, o, _ in od}:
        d = {s: 0.0}
        for _ in range(12):
            for a, b, w in edges:
                if a in d and d[a] + w < d.get(b, math.inf):
                    d[b] = d[a] + w
        dist[s] = d
    got = graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string, weight_sec double"), spark.createDataFrame(od, "od_id long, src string, dst string"))
    assert {r.od_id: r.cost_sec for r in got.collect()} == {k: dist[s].get(t) for k, s, t in od}


def test_verify_distances(spark):
    a = spark.createDataFrame([(1, True, 5.0), (2, False, None)], "od_id long, found boolean, cost_sec double")
    b = spark.createDataFrame([(1, True, 5.0), (2, True, 1.0)], "od_id long, found boolean, cost_sec double")
    assert graph.verify_distances(a, a).first().status == "PASS"
    assert graph.verify_distances(a, b).first().mismatches == 1


def test_override_rules(spark):
    e = [(1, "override", False, "n", "a"), (2, "override", False, "n", "b"), (3, "release", False, "n", "b"), (4, "override", True, "n", "b"), (5, "override", False, "n", "b"), (6, "release_all", False, "n", "x")]
    lamps = "CAST(NULL AS string) AS controller", "CAST(NULL AS array<struct<wayId:string,movement:string>>) AS green_lamps", "IF(event_id = 4, ' w ', NULL) AS way_id"
    holds, rejected = signals.override_holds(spark.createDataFrame(e, "event_id long, action string, force boolean, node_id string, token string").selectExpr("*", *lamps))
    assert sorted((r.token, r.controller, r.lamps) for r in holds.collect()) == [("a", "unknown", ""), ("b", "unknown", "")]  # event 5 changes b's hold to all red
    assert sorted((r.token, r.since, r.until) for r in holds.collect()) == [("a", 1, 4), ("b", 4, 6)]
    assert [r.event_id for r in rejected.collect()] == [2]


def test_session_ends_after_more_than_twenty_seconds(spark):
    f = spark.createDataFrame([("v", t) for t in (0, 20, 41)], "vehicle_id string, t long")
    assert sorted((r.start, r.end, r.fixes) for r in telemetry.live_sessions(f).collect()) == [(0, 20, 2), (41, 41, 1)]


def test_no_cross_join_in_spatial_plans(spark):
    n = nodes(spark, a=(0, 0), b=(10, 0))
    w = ways(spark, [("a", "primary", {}, ["a", "b"])])
    plan = spatial.segment_crossings(w, n)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bad_gps_goes_to_quarantine(spark):
    raw = ['{"vehicleId":"v","vehicleType":"car","lat":1,"lon":2,"headingDeg":-90}', '{"vehicleId":"v","vehicleType":"car","lat":95,"lon":2}', '{"vehicleType":"car","lat":1,"lon":2}', '{"vehicleId":"v","vehicleType":"boat","lat":1,"lon":2}', "no json"]
    good, bad = telemetry.parse_gps(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert [r.heading_deg for r in good.collect()] == [270.0]
    assert sorted(r.reason for r in bad.collect()) == ["missing field", "missing field", "position out of range", "unknown type"]
    assert bad.where(F.col("reason").isNull()).isEmpty()
