"""Routes, strong components, joint groups, sources and the upsert stream on small inputs."""

import itertools
import math
from hashlib import sha256

from pyspark.sql import functions as F

from roadspark.operators import edits, joins, routes, telemetry
from roadspark.sources.files import parse_state_ticks, read_osm, read_trips, write_trips
from roadspark.streaming.sink import Part, outweighed, read_keyed, upsert_sink

OSM = """<?xml version="1.0"?><osm><bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/>
<node id="1" lat="1.5" lon="2.5"/><node id="2" lat="1.6" lon="2.6"><tag k="amenity" v="cafe"/></node><node id="3" lat="1.7" lon="2.7"/>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="11"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>
<way id="12"><nd ref="1"/><tag k="highway" v="primary"/></way><relation id="9"/></osm>"""


def test_read_osm(spark, tmp_path):
    (tmp_path / "map.osm").write_text(OSM)
    nodes, roads, features, bounds = read_osm(spark, str(tmp_path / "map.osm"))
    assert {r.node_id: r.tags for r in nodes.collect()} == {"1": {}, "2": {"amenity": "cafe"}, "3": {}}
    assert [(r.way_id, r.nodes) for r in roads.collect()] == [("10", ["1", "2"])]
    assert [r.way_id for r in features.collect()] == ["11"]
    assert tuple(bounds.first()) == (1.0, 2.0, 3.0, 4.0)


def test_route_paths_and_steps(spark):
    edges = [(f"n{a}", f"n{b}", float(1 + (a * 7 + b * 3) % 11)) for a in range(12) for b in range(12) if a != b and (a * 5 + b) % 4 == 0]
    od = [(k, f"n{k % 12}", f"n{(k * 5 + 2) % 12}") for k in range(20)]
    cost = {(a, b): w for a, b, w in edges}
    dist = {(s, s): 0.0 for s, _, _ in edges}
    for _ in range(12):
        for (s, u), d in list(dist.items()):
            for (a, b), w in cost.items():
                if a == u and d + w < dist.get((s, b), math.inf):
                    dist[s, b] = d + w
    got = routes.route_paths(spark.createDataFrame(edges, "src string, dst string, weight_sec double"), spark.createDataFrame(od, "od_id long, src string, dst string")).collect()
    assert len(got) == 20
    for r in got:
        _, s, t = od[r.od_id]
        assert r.cost_sec == dist.get((s, t)) or (r.cost_sec is None and (s, t) not in dist)
        assert not r.found or (r.path[0], r.path[-1]) == (s, t) and sum(cost[x] for x in itertools.pairwise(r.path)) == r.cost_sec
    paths = spark.createDataFrame([(1, ["a", "b#fwd", "b", "c", "z"])], "trip_id long, path array<string>")
    chain = spark.createDataFrame([("e1", "a", "b", 5.0)], "edge_id string, src string, dst string, length_m double")
    cross = spark.createDataFrame([("b", "c", 2.0)], "src string, dst string, length_m double")
    steps, lost = routes.route_steps(paths, chain, cross)
    assert sorted((r.step, r.edge_id, r.is_junction) for r in steps.collect()) == [(0, "e1", False), (1, "b>c", True)]
    assert [(r.src, r.dst) for r in lost.collect()] == [("c", "z")]


def test_largest_scc_by_mutual_reachability(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"), ("y", "x")]
    assert {r.node_id for r in routes.largest_scc(spark.createDataFrame(edges, "src string, dst string")).collect()} == {"a", "b", "c"}


def test_join_groups_caps_the_span(spark):
    nodes = spark.createDataFrame([(f"n{k}", 9.0 * k, 0.0) for k in range(4)] + [("p", 500.0, 0.0), ("q", 510.1, 0.0)], "node_id string, x double, y double")
    con = [("w0", 0, "n0", "n1", 0, 9.0), ("w1", 1, "n1", "n2", 0, 9.0), ("w2", 2, "n2", "n3", 0, 9.0), ("w3", 3, "n0", "n2", 0, 9.5), ("w4", 9, "n0", "n1", 1, 9.0), ("loop", 5, "p", "p", 0, 1.0), ("long", 4, "p", "q", 0, 10.1)]
    status, groups = joins.join_groups(spark.createDataFrame(con, "way_id string, ord long, start_id string, end_id string, layer int, len double"), nodes)
    assert {r.way_id: r.status for r in status.collect()} == {"w0": "dissolved", "w1": "dissolved", "w2": "refused", "w3": "dissolved", "w4": "dissolved", "loop": "kept", "long": "kept"}
    want = {("n0", 0): "n0@0", ("n1", 0): "n0@0", ("n2", 0): "n0@0", ("n3", 0): "n3@0", ("n0", 1): "n0@1", ("n1", 1): "n0@1", ("p", 0): "p@0", ("q", 0): "q@0"}
    assert {(r.node_id, r.layer): r.group_id for r in groups.collect()} == want


def test_join_groups_of_a_road_whose_lengths_grow(spark, monkeypatch):
    """a round for each connector of the road. Tiles are so narrow here that the road crosses many."""
    at = [0.0]
    for k in range(60):
        at.append(at[-1] + 5 + 0.05 * k)
    nodes = spark.createDataFrame([(f"n{k:02}", x, 0.0) for k, x in enumerate(at)], "node_id string, x double, y double")
    con = [(f"w{k:02}", k, f"n{k:02}", f"n{k + 1:02}", 0, at[k + 1] - at[k]) for k in range(60)]
    want, group = {}, {k: [k] for k in range(61)}
    for k in range(60):
        both = group[k] + group[k + 1]
        fits = at[max(both)] - at[min(both)] <= 20.0
        want[f"w{k:02}"] = "dissolved" if fits else "refused"
        for n in both if fits else ():
            group[n] = both
    rounds = []
    store = joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, name: (rounds.append(name), store(df, name))[1])
    table = spark.createDataFrame(con, "way_id string, ord long, start_id string, end_id string, layer int, len double")
    for tile, most in ((1000.0, 1), (90.0, 8)):
        monkeypatch.setattr(joins, "TILE_M", tile)
        rounds.clear()
        status, groups = joins.join_groups(table, nodes, span_m=20.0)
        assert {r.way_id: r.status for r in status.collect()} == want
        assert {r.node_id: r.group_id for r in groups.collect()} == {f"n{n:02}": f"n{min(g):02}@0" for n, g in group.items()}
        assert rounds.count("decided") <= most


def test_remap_merges_tags_and_drops_repeats(spark):
    n = spark.createDataFrame([("a", 0.0, 0.0, {"k": "old", "m": "1"}), ("b", 1.0, 0.0, {"k": "mine"}), ("c", 2.0, 0.0, {})], "node_id string, x double, y double, tags map<string,string>")
    w = spark.createDataFrame([("w", 0, {}, ["a", "b", "c"]), ("s", 1, {}, ["a", "b"])], "way_id string, ord long, tags map<string,string>, nodes array<string>")
    nodes, ways = edits.remap_nodes(n, w, spark.createDataFrame([("a", "b")], "from_id string, into_id string"))
    assert {r.node_id: r.tags for r in nodes.collect()} == {"b": {"k": "mine", "m": "1"}, "c": {}}
    assert {r.way_id: r.nodes for r in ways.collect()} == {"w": ["b", "c"]}


def test_trips_keep_nulls_and_get_defaults(spark, tmp_path):
    t = spark.createDataFrame([(1, None, "a", "b", None, 2.0, None, None), (2, "bus", "c", "d", 9.0, 2.5, 80.0, "h")], "id long, vehicleType string, startNodeId string, endNodeId string, length double, width double, maxSpeedKmh double, homeAmenityId string")
    for fmt in ("csv", "json"):
        write_trips(t, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(tuple, read_trips(spark, f"{tmp_path}/{fmt}", fmt).collect())) == [(1, "car", "a", "b", 4.5, 2.0, 140.0, None), (2, "bus", "c", "d", 9.0, 2.5, 80.0, "h")]


def test_state_ticks(spark):
    raw = spark.createDataFrame([('{"t":1.5,"spawned":3,"completed":1,"vehicles":[{"id":"v","x":1,"y":2,"s":3,"ty":"car","em":1}],"lamps":[{"nodeId":"n","wayId":"w","movement":"right","color":"red","r":4}]}',)], "value string")
    header, vehicles, lamps, weights = parse_state_ticks(raw)
    assert tuple(header.first()) == (1.5, 3, 1, 1)
    assert (vehicles.first().emergency, vehicles.first().stuck) == (True, False)
    assert lamps.first().remaining_sec == 4.0 and weights.count() == 0


def test_upsert_sink_keeps_the_newest(spark, tmp_path):
    where, schema = f"{tmp_path}/t", "k string, t long, v string"
    write = upsert_sink(where, "k", "t", buckets=4)
    table = lambda: sorted(map(tuple, read_keyed(spark, where, "k", "t", spark.createDataFrame([], schema).schema).collect()), key=str)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("part-*") if "manifest" not in str(f))
    assert table() == []
    write(spark.createDataFrame([(f"k{i}", 5, sha256(str(i).encode()).hexdigest()) for i in range(4000)] + [(None, 1, "none")], schema), 0)
    first, want = size(), {f"k{i}": (f"k{i}", 5, sha256(str(i).encode()).hexdigest()) for i in range(4000)} | {None: (None, 1, "none")}
    for epoch in range(1, 7):
        rows = [("k7", 5, f"tie{epoch}"), ("k8", 4, "late"), (f"k{epoch}", 6, "new"), (f"n{epoch}", 1, "added")]
        before = size()
        write(spark.createDataFrame(rows, schema), epoch)
        assert size() - before < first / 10  # a batch writes in proportion to itself
        if epoch == 3:
            write(spark.createDataFrame(rows, schema), epoch)  # repeated after a failure
        want |= {r[0]: r for r in rows if r[1] >= want.get(r[0], (0, 0))[1]}
        if epoch in (3, 6):
            assert table() == sorted(want.values(), key=str)
    write(spark.createDataFrame([], schema), 7)
    assert table() == sorted(want.values(), key=str)
    assert len(list((tmp_path / "t/manifest").iterdir())) == 2


def test_parts_shrink_by_half():
    part = lambda *rows: [Part(0, "rows", k, n) for k, n in enumerate(rows)]
    assert outweighed(part(100, 30, 10)) == [] and outweighed(part(5)) == []
    assert [p.rows for p in outweighed(part(100, 30, 20, 10))] == [30, 20, 10] and [p.rows for p in outweighed(part(3, 60, 57))] == [60, 57, 3]


def test_incident_states(spark):
    i = spark.createDataFrame([(1,), (2,), (3,)], "incident_id long")
    e = spark.createDataFrame([(7, 1, "dispatch", 5), (7, 1, "incident_arrival", 9), (8, 2, "dispatch", 4), (9, 2, "dispatch", 6), (9, 2, "recall", 8)], "vehicle_id long, incident_id long, event string, t long")
    assert sorted(map(tuple, telemetry.incident_lifecycle(i, e).collect())) == [(1, "resolved", 5, 9), (2, "responding", 4, None), (3, "pending", None, None)]
    assert telemetry.incident_lifecycle(i, e).where(F.col("status").isNull()).isEmpty()


def test_curves_that_mix_corners_and_splines(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, {}), ("b", 10.0, 0.0, {"vertex_type": "curve"}), ("c", 10.0, 20.0, {"vertex_type": "angle"}), ("d", 30.0, 20.0, {})], "node_id string, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([("line", ["a", "b", "c", "d"], "line"), ("spline", ["a", "b", "c", "d"], "spline"), ("gap", ["a", "zz", "b"], "spline"), ("two", ["a", "d"], None)], "way_id string, nodes array<string>, curve string")
    got = {}
    for r in edits.mixed_curve_points(ways, nodes).orderBy("way_id", "seq").collect():
        got.setdefault(r.way_id, []).append((round(r.x, 6), round(r.y, 6)))
    assert got["two"] == [(0, 0), (30, 20)] and got["gap"] == [(0, 0), (10, 0)]
    line = got["line"]
    assert len(line) == 12 and line[:2] == [(0, 0), (6, 0)] and line[5] == (9, 1) and line[9:] == [(10, 4), (10, 20), (30, 20)]
    spline = got["spline"]
    assert len(spline) == 25 and spline[0] == (0, 0) and spline[8] == (10, 0) and spline[16] == (10, 20) and spline[24] == (30, 20)
    assert all(y == 20 for _, y in spline[16:])  # past the angle the curve starts anew
