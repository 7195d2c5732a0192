"""Work that has to grow no faster than the tables: no broadcast of exploded rows, no pair for each two of equal rows, files in order."""

import math
import re

import pytest
from pyspark.sql import functions as F

from roadspark.operators import spatial, telemetry, trips


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, n=30):
    return spark.range(n).selectExpr("id", "CAST(id % 5 * 30 AS DOUBLE) AS x", "CAST(id div 5 * 30 AS DOUBLE) AS y", "0L AS t", "0.0D AS heading")


def road(spark, kind="primary"):
    nodes = grid(spark).selectExpr("concat('n', id) AS node_id", "x", "y")
    return nodes, spark.createDataFrame([("w", {"highway": kind}, [f"n{k}" for k in range(30)])], "way_id string, tags map<string,string>, nodes array<string>")


@pytest.mark.parametrize("exact", [False, True])
def test_nearest_major_road_is_not_broadcast(spark, exact):
    nodes, ways = road(spark)
    points = grid(spark).selectExpr("id", "x + 7 AS x", "y + 200 AS y")
    near = spatial.nearest_major_road(points, nodes, ways, exact=exact)
    assert "cx" in plan(near) and not any("BroadcastHashJoin" in line and "cx" in line for line in plan(near).splitlines())
    got = {r["id"]: r["dist_m"] for r in near.collect()}
    spots = [(r["x"], r["y"]) for r in nodes.collect()]
    for p in points.collect():
        d = min(((p["x"] - x) ** 2 + (p["y"] - y) ** 2) ** 0.5 for x, y in spots)
        assert (p["id"] in got) == (d < 150.0) and abs(got.get(p["id"], d) - d) < 1e-9


def test_vision_cone_and_close_pairs_are_not_broadcast(spark):
    v = grid(spark)
    for df in (spatial.vision_cone(v, v, 0.45, 50.0), spatial.close_pairs(v, 50.0)):
        assert "BroadcastHashJoin" not in plan(df) and df.count() > 0


def test_endpoints_are_not_broadcast(spark):
    nodes = grid(spark).selectExpr("concat('n', id) AS node_id", "x", "y")
    df = trips.sample_endpoints(spark.range(40), nodes, 3, 10.0, 20)
    assert "BroadcastHashJoin" not in plan(df) and df.count() == 40


def test_endpoints_have_all_tries(spark, monkeypatch):
    """The query drew 12 tries of the operator's 50, and all of them for every id."""
    import roadspark.queries_more as Q

    nodes = spark.range(250).selectExpr("concat('n', lpad(id, 3, '0')) AS node_id", "CAST(id AS DOUBLE) AS x", "0.0D AS y")
    monkeypatch.setattr(Q.X, "nodes", lambda s, d: nodes)
    monkeypatch.setattr(Q.X, "trips", lambda s, d: spark.range(400).selectExpr("id AS trip_id"))
    got = {r["id"]: (int(r["start_node"][1:]), int(r["end_node"][1:])) for r in Q.sample_endpoints(spark, "").collect()}
    grown = lambda x: (x % 2**31 * 1103515245 + 12345) % 2**31
    draw = lambda *parts: (lambda once: grown(once ^ once >> 15))(grown(5 + sum(p * m for p, m in zip(parts, (7919, 104729, 1299709), strict=True)))) * 250 // 2**31
    for i in range(400):
        drawn = [p for p in ((draw(i, t, 0), draw(i, t, 1)) for t in range(50)) if p[0] != p[1]]
        assert got[i] == next((p for p in drawn if abs(p[0] - p[1]) >= 200), drawn[-1])
    assert len(got) == 400 and sum(abs(a - b) >= 200 for a, b in got.values()) > 300
    assert trips.sample_endpoints(spark.range(3), nodes.limit(1), 3, 10.0).count() == 0


def test_clock_without_a_pair_for_each_hold(spark):
    from roadspark.operators.signals import signal_clock

    holds = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 40, 40), ("a", 50, None), ("b", 5, 3), (None, 1, 9)], "node_id string, since long, until long")
    asks = spark.createDataFrame([("a", t, "x") for t in (0, 10, 12, 30, 35, 45, 60)] + [("b", 9, "y"), ("c", 4, "z"), (None, 8, "n"), ("a", 60, "x")], "node_id string, t long, tag string")
    df = signal_clock(holds, asks)
    assert "Join" not in plan(df)
    got = {(r["node_id"], r["t"]): r["clock_sec"] for r in df.collect()}
    assert got == {("a", 0): 0, ("a", 10): 10, ("a", 12): 10, ("a", 30): 10, ("a", 35): 15, ("a", 45): 25, ("a", 60): 30, ("b", 9): 9, ("c", 4): 4, (None, 8): 8}
    assert df.count() == 10 and df.columns == ["node_id", "t", "tag", "clock_sec"]


def test_lane_cost_counts_equal_vehicles_once(spark):
    rows = [(0, k, 1, 0, float(k % 3), None if k == 7 else float(5 + k % 2)) for k in range(40)]
    states = spark.createDataFrame(rows, "t long, vehicle_id long, edge long, lane long, dist double, speed_mps double")
    df = telemetry.lane_vision_cost(states, 2.0)
    assert "count(1)" in plan(df)
    got = {r["id"]: r["cost"] for r in df.collect()}
    want = {}
    for _, a, _, _, d, v in rows:
        for _, _, _, _, e, u in rows:
            if 0 < e - d < 2.0:
                want[a] = want.get(a, 0) + (max(0.0, v - u) if None not in (u, v) else 0.0) * (1 - (e - d) / 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stream_files_come_in_order(spark, monkeypatch, tmp_path):
    from roadspark import queries_live

    monkeypatch.setattr(queries_live, "shared_dir", lambda s: str(tmp_path))
    monkeypatch.setattr(queries_live, "ROWS_A_FILE", 2_500)
    events = spark.range(20_000, numPartitions=8).selectExpr("(id * 7919) % 20000 AS t")
    assert queries_live.as_stream(events, spark.createDataFrame([(10**9,)], "t long"), "t").isStreaming
    files = sorted((p for p in tmp_path.glob("source-*/*.parquet") if "ranges" not in str(p.parent)), key=lambda p: p.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(p)).agg(F.min("t"), F.max("t"), F.count("t")).first() for p in files]
    assert len(files) >= 8 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(x[2] for x in spans) == 20_001


def test_lamp_asks_are_not_broadcast(spark):
    from roadspark.operators.signals import lamp_state_phases

    phase = "array(named_struct('id', 'p', 'wayIds', array('w'), 'greenSec', 10.0D, 'yellowSec', 3.0D))"
    signals = spark.range(1).selectExpr("'n' AS node_id", "'phases' AS scheme", "2.0D AS all_red_sec", f"{phase} AS phases", "CAST(NULL AS struct<yellowSec:double,pairs:array<struct<wayIds:array<string>,stepSec:double>>>) AS paired")
    asks = spark.range(15).selectExpr("'n' AS node_id", "'w' AS way_id", "CAST(id AS DOUBLE) AS t")
    df = lamp_state_phases(signals, asks)
    assert "BroadcastHashJoin" not in plan(df)
    assert [r["color"] for r in df.orderBy("t").collect()] == ["green"] * 10 + ["yellow"] * 3 + ["red"] * 2


def test_accidents_meet_stops_and_not_whole_roads(spark):
    from roadspark.operators.incidents import place_incidents

    nodes, ways = road(spark)
    spots = nodes.where("node_id <> 'n3'")
    none = spark.createDataFrame([], "building_id string, tags map<string,string>, polygon array<struct<x:double,y:double>>")
    df = place_incidents(spark.range(400).selectExpr("id AS attempt"), none, ways, spots, 5)
    assert "posexplode(nodes" in plan(df)
    rows = df.collect()
    found = [r for r in rows if r["x"] is not None]
    assert len(rows) == 400 and 0 < len(found) < 400 and {r["kind"] for r in found} == {"accident", "medical"}
    assert all(0 <= r["x"] <= 120 and 0 <= r["y"] <= 150 for r in found)


def test_retagging_broadcasts_no_cells(spark):
    nodes, ways = road(spark)
    square = "array(named_struct('x', x, 'y', y), named_struct('x', x + 5, 'y', y), named_struct('x', x + 5, 'y', y + 5), named_struct('x', x, 'y', y + 5))"
    buildings = grid(spark).selectExpr("concat('b', id) AS building_id", "id AS ord", "map('building', 'yes') AS tags", f"{square} AS polygon")
    amenities = spark.createDataFrame([], "amenity_id string, ord long, x double, y double, tags map<string,string>, building_id string")
    df = spatial.retag_buildings(buildings, amenities, nodes, ways)
    assert not any("BroadcastHashJoin" in line and "cx" in line for line in plan(df).splitlines())
    assert {r["building"] for r in df.collect()} == {"commercial"}


def test_footprints_are_not_broadcast(spark):
    square = "array(named_struct('x', x, 'y', y), named_struct('x', x + 5, 'y', y), named_struct('x', x + 5, 'y', y + 5), named_struct('x', x, 'y', y + 5))"
    buildings = grid(spark).selectExpr("concat('b', id) AS building_id", "id AS ord", f"{square} AS polygon")
    df = spatial.point_in_building(grid(spark).selectExpr("id", "x + 1 AS x", "y + 1 AS y"), buildings)
    assert "BroadcastHashJoin" not in plan(df)
    assert {(r["id"], r["building_id"]) for r in df.collect()} == {(k, f"b{k}") for k in range(30)}


def test_footprints_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """what a task sorts grew with the input."""
    square = "array(named_struct('x', x, 'y', y), named_struct('x', x + 5, 'y', y), named_struct('x', x + 5, 'y', y + 5), named_struct('x', x, 'y', y + 5))"
    buildings = grid(spark).selectExpr("concat('b', id) AS building_id", "id AS ord", f"{square} AS polygon")
    monkeypatch.setattr(spatial, "ROWS_A_TASK", 10, raising=False)
    df = spatial.point_in_building(grid(spark).selectExpr("id", "x + 1 AS x", "y + 1 AS y"), buildings)
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(cx#\w+, cy#\w+, (\d+)\)", plan(df))]
    assert len(tasks) == 2 and min(tasks) >= 6
    assert df.count() == 30


def test_close_pairs_compare_spots_not_vehicles(spark, monkeypatch):
    """Distances were worked out, and rounded, for each pair of vehicles; those at one spot have the same."""
    monkeypatch.setattr(spatial, "IDS_A_ROW", 3, raising=False)
    rows = [(t, v, float(v % 7 * 9), float(v % 3 * 8 - 8)) for t in (0, 1) for v in range(0, 90, 1 + t)]
    rows += [(0, 3, 27.0, -8.0), (0, 5, 300.0, 0.0), (0, None, 0.0, 0.0), (None, 7, 0.0, 0.0), (0, 91, None, 0.0), (0, 92, float("nan"), 0.0), (0, 93, -0.0, 0.0), (0, 94, 0.0, -8.0)]
    states = spark.createDataFrame(rows, "t long, id long, x double, y double")
    want = []
    for t, i, x, y in rows:
        for u, j, z, w in rows:
            if None not in (t, i, x, u, j, z) and t == u and i < j and ((x - z) ** 2 + (y - w) ** 2) ** 0.5 < 20:
                want.append((t, i, j, round(((x - z) ** 2 + (y - w) ** 2) ** 0.5, 4)))
    df = spatial.close_pairs(states, 20.0, 4)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and df.columns == ["t", "id_a", "id_b", "dist_m"]
    lines = plan(df).splitlines()
    assert next(k for k, line in enumerate(lines) if "explode(ids_b" in line) < next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)


def _cone(rows, half_angle, range_m):
    """t, id, other_id, dist_m, bearing, closing_mps of rows (t, id, x, y, heading, speed_mps), pair by pair."""
    for t, i, x, y, h, _ in rows:
        for u, j, z, w, g, v in rows:
            if None in (t, i, x, u, j, z, h) or t != u or i == j or not math.dist((x, y), (z, w)) <= range_m:
                continue
            d, turn = math.dist((x, y), (z, w)), (math.atan2(w - y, z - x) - h + math.pi) % (2 * math.pi) - math.pi
            if abs(turn) <= half_angle:
                yield t, i, j, d, turn, None if None in (g, v) else v * (math.cos(g) * (x - z) + math.sin(g) * (y - w)) / max(1e-6, d)


def test_vision_cone_has_closing_speeds_and_compares_lists(spark, monkeypatch):
    """There were no closing speeds, and each pair of vehicles was compared by itself."""
    monkeypatch.setattr(spatial, "IDS_A_ROW", 3)
    rows = [(t, v, float(v % 7 * 9), float(v % 3 * 8 - 8), v % 5 * 1.3, v % 4 * 2.5) for t in (0, 1) for v in range(0, 60, 1 + t)]
    rows += [(0, 3, 27.0, -8.0, 0.2, 1.0), (0, 91, None, 0.0, 0.0, 1.0), (0, 92, 1.0, 1.0, None, 1.0), (0, 93, 2.0, 1.0, 0.1, None), (0, None, 0.0, 0.0, 0.0, 1.0), (None, 7, 0.0, 0.0, 0.0, 1.0)]
    states = spark.createDataFrame(rows, "t long, id long, x double, y double, heading double, speed_mps double")
    df = spatial.vision_cone(states, states, 0.45, 30.0)
    close = lambda found: sorted(((*r[:3], *(None if v is None else round(v, 9) + 0.0 for v in r[3:])) for r in found), key=str)
    assert close(tuple(r) for r in df.collect()) == close(_cone(rows, 0.45, 30.0)) and df.columns == ["t", "id", "other_id", "dist_m", "bearing", "closing_mps"]
    lines = plan(spatial.vision_cone(states, states, 0.45, 30.0, 4)).splitlines()
    assert next(k for k, line in enumerate(lines) if "explode(ids_b" in line) < next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    ahead = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 5.0), (0, 2, 10.0, 0.0, math.pi, 3.0)], states.schema)
    assert [(r["id"], round(r["closing_mps"], 9)) for r in spatial.vision_cone(ahead, ahead, 0.45, 30.0).orderBy("id").collect()] == [(1, 3.0), (2, 5.0)]


def test_vehicles_of_a_message_are_read_behind_the_shuffle(spark):
    """A source's few files were parsed by as few tasks, twins and all."""
    from roadspark.streaming import states

    value = ['{"t":1.0,"vehicles":[{"id":1,"x":2.5},{"id":2}]}'] * 2 + ['{"t":2.0,"vehicles":[]}', '{"t":3.0}', '{"vehicles":[{"id":9}]}', "{", None, '{"t":4.0,"vehicles":[{"id":1}]}']
    raw = spark.createDataFrame([(v,) for v in value], "value string")
    df = states.stream_state_join(raw, spark.createDataFrame([(1, "bus"), (1, "car")], "id long, kind string"))
    lines = plan(df).splitlines()  # before it runs, without a final plan beside it
    assert sorted(((r["t"], r["id"], r["x"], r["kind"]) for r in df.collect()), key=str) == [(1.0, 1, 2.5, "bus"), (1.0, 2, None, None), (4.0, 1, None, "bus")]
    parsed = [k for k, line in enumerate(lines) if "StructField(vehicles" in line]
    assert parsed and max(parsed) < next(k for k, line in enumerate(lines) if "Exchange hashpartitioning(ts" in line)
