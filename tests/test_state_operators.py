"""Lamp precedence, clocks, lane changes, destinations and reroutes on hand-made rows."""

import random

from roadspark.operators import signals, telemetry, trips


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lamp_precedence(spark):
    asks = spark.createDataFrame([(n, "w", m, 0.0) for n in ("held", "sent", "plan") for m in ("through", "right")], "node_id string, way_id string, movement string, t double")
    overrides = spark.createDataFrame([("held", "w", "through")], "node_id string, way_id string, movement string")
    streamed = spark.createDataFrame([("held", "w", "right", "green"), ("sent", "w", "through", "yellow")], "node_id string, way_id string, movement string, color string")
    plans = asks.selectExpr("node_id", "way_id", "movement", "t", "'yellow' AS color").where("node_id <> 'plan' or movement = 'through'")
    got = {(r.node_id, r.movement): (r.color, r.source) for r in signals.lamp_state(asks, overrides, streamed, plans).collect()}
    assert got == {("held", "through"): ("green", "override"), ("held", "right"): ("red", "override"), ("sent", "through"): ("yellow", "streamed"), ("sent", "right"): ("green", "streamed"), ("plan", "through"): ("yellow", "plan"), ("plan", "right"): ("red", "plan")}


def test_overlapping_holds_freeze_once(spark):
    holds = spark.createDataFrame([("n", 10, 20), ("n", 15, 30), ("n", 50, None)], "node_id string, since long, until long")
    asks = spark.createDataFrame([("n", 5), ("n", 25), ("n", 40), ("n", 60), ("m", 9)], "node_id string, t long")
    assert rows(signals.signal_clock(holds, asks)) == [("m", 9, 9), ("n", 5, 5), ("n", 25, 10), ("n", 40, 20), ("n", 60, 30)]


def test_wide_neighbours_need_more_room(spark):
    gaps = spark.createDataFrame([(0, 1, 6.0, 1.8, None, None), (0, 2, 6.0, 2.5, None, None), (0, 3, None, None, 5.0, 1.8), (0, 4, None, None, None, None)], "t long, vehicle_id long, gap_m double, ahead_width double, gap_behind_m double, behind_width double")
    assert rows(telemetry.lane_change_safe(gaps)) == [(0, 1, True), (0, 2, False), (0, 3, False), (0, 4, True)]


def test_destination_only_on_the_way_back(spark):
    states = spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "t long, vehicle_id long, phase int")
    homes = spark.createDataFrame([(7, "a"), (7, "a"), (8, "a")], "vehicle_id long, amenity_id string")
    amenities = spark.createDataFrame([("a", 1.0, 2.0, {"name": "General"})], "amenity_id string, x double, y double, tags map<string,string>")
    assert rows(telemetry.vehicle_destination(states, homes, amenities)) == [(1, 7, "a", "General", 1.0, 2.0)]


def test_live_costs(spark):
    edges = spark.createDataFrame([("a", 100.0, 10.0), ("b", 50.0, 10.0)], "edge_id string, length_m double, speed_mps double")
    live = spark.createDataFrame([("a", 0.5)], "edge_id string, live_mps double")
    costs = telemetry.live_edge_cost(edges, live)
    assert rows(costs) == [("a", 50.0), ("b", 5.0)]
    steps = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b")], "trip_id string, step int, edge_id string")
    assert rows(telemetry.remaining_cost(steps, costs)) == [("t", 0, 55.0), ("t", 1, 5.0)]


def test_reroutes_are_those_of_unbounded_searches(spark):
    """Every vehicle's route against all routes from the end of its edge; slow edges ahead make some switch."""
    draw = random.Random(6)
    arcs = {(f"n{a}", f"n{b}"): float(draw.randrange(20, 200)) for a in range(9) for b in range(9) if a != b and draw.random() < 0.3}
    slow = {e: 2.5 for e in arcs if draw.random() < 0.3}
    cost = {e: m / max(2.0, slow.get(e, 10.0)) for e, m in arcs.items()}
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, m, 10.0) for (a, b), m in arcs.items()], "edge_id string, src string, dst string, length_m double, speed_mps double")
    live = spark.createDataFrame([(f"{a}>{b}", v) for (a, b), v in slow.items()], "edge_id string, live_mps double")
    vehicles, steps, want = [], [], []
    for k in range(40):
        walk = [draw.choice(sorted(arcs))]
        while len(walk) < 5 and (further := [e for e in sorted(arcs) if e[0] == walk[-1][1]]):
            walk.append(draw.choice(further))
        now = draw.randrange(2)
        vehicles.append((k, now, walk[-1][1], k % 9 == 8, k % 7 == 6))
        steps += [(k, i, f"{a}>{b}", k % 10 == 9 and i == now) for i, (a, b) in enumerate(walk)]
        if k % 9 == 8 or k % 7 == 6 or k % 10 == 9 or len(walk) <= now + 1 or walk[now][1] == walk[-1][1]:
            continue
        left, best = sum(cost[e] for e in walk[now + 1 :]), {walk[now][1]: 0.0}
        for _ in range(9):
            for (a, b), c in cost.items():
                if a in best:
                    best[b] = min(best.get(b, float("inf")), best[a] + c)
        new = best.get(walk[-1][1])
        want.append((k, round(left, 6), round(new, 6) if new is not None and new < 0.85 * left else None))
    got = telemetry.fresh_routes(
        spark.createDataFrame(vehicles, "vehicle_id long, step int, dest_node string, emergency boolean, tracked boolean"), spark.createDataFrame(steps, "vehicle_id long, step int, edge_id string, is_junction boolean"), edges, live
    ).collect()
    assert sorted((r.vehicle_id, round(r.current_sec, 6), None if r.new_sec is None else round(r.new_sec, 6)) for r in got) == want
    assert 2 < sum(r.switch for r in got) < len(got)
    for r in got:
        assert r.switch == (r.new_sec is not None) == bool(r.path)
        assert not r.switch or abs(sum(cost[e] for e in zip(r.path, r.path[1:])) - r.new_sec) < 1e-6


def test_fleets_flatten_and_report_duplicates(spark):
    fleet = "array<struct<id:string,vehicleType:string,vehicles:array<struct<id:string,length:double,maxSpeed:double>>>>"
    a = spark.createDataFrame([("a", [("f", "car", [("v1", 4.0, 100.0), ("v2", 4.1, 90.0)])]), ("b", [("g", "bus", [("v1", 9.0, 80.0)])]), ("c", None)], f"amenity_id string, fleets {fleet}")
    flat, twice = trips.fleet_vehicles(a)
    assert flat.count() == 4 and rows(twice) == [("v1", 2)]


def test_endpoints_differ_and_are_far(spark):
    nodes = spark.createDataFrame([(f"n{k}", float(k), 0.0) for k in range(50)], "node_id string, x double, y double")
    got = trips.sample_endpoints(spark.range(40), nodes, 3, 10.0, 20).collect()
    assert len(got) == 40 and all(abs(int(r.start_node[1:]) - int(r.end_node[1:])) >= 10 for r in got)


def test_generated_trips(spark):
    nodes = spark.createDataFrame([(f"n{k}", 50.0 * k, 0.0) for k in range(60)], "node_id string, x double, y double")
    depots = spark.createDataFrame([("ambulance", "h1", "n1"), ("ambulance", "h2", "n2"), ("police", "p", "n3"), ("firetruck", "p", "n3")], "type string, depot_id string, node_id string")
    got = trips.generate_trips(spark, nodes, depots, 200, 7).collect()
    count = {k: sum(r.type == k for r in got) for k in trips.PROFILES}
    assert len({r.id for r in got}) == len(got) == 200
    assert count == {r.type: r.n for r in trips.apportion_counts(spark, 200).collect()}
    for r in got:
        assert trips.PROFILES[r.type]["length"][0] <= r.length <= trips.PROFILES[r.type]["length"][1] and 16 <= r.driver_age <= 80
        assert (r.home_depot is not None) == (r.type in trips.C.EMERGENCY_TYPES)
        if r.home_depot is None:
            assert abs(int(r.start_node[1:]) - int(r.end_node[1:])) >= 4
    assert {r.home_depot for r in got if r.type == "ambulance"} == {"h1", "h2"}


def test_preemption_asks_for_the_next_signal(spark):
    from roadspark.operators import routes

    steps = spark.createDataFrame([("v", 0, 50.0, None), ("v", 1, 10.0, "J1"), ("v", 2, 30.0, None), ("v", 3, 10.0, "J2")], "vehicle_id string, step int, length_m double, junction_id string")
    states = spark.createDataFrame([(0, "v", 0, 50.0, 10.0, True, 0.0), (1, "v", 0, 50.0, 1.0, True, 0.0), (2, "v", 1, 5.0, 0.0, True, 9.0), (3, "v", 2, 20.0, 10.0, True, 6.0), (4, "v", 2, 20.0, 10.0, False, 0.0), (5, "v", 2, 20.0, 10.0, True, 0.0)], "t long, vehicle_id string, step int, left_m double, speed_mps double, responding boolean, stuck_for double")
    assert rows(routes.preempt_requests(states, steps)) == [(0, "v", "J1", 5.0), (2, "v", "J1", 0.0), (5, "v", "J2", 2.0)]


def test_path_metrics(spark):
    from roadspark.operators import routes

    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 3.0, 10.0)], "node_id string, x double, y double")
    paths = spark.createDataFrame([(1, ["a", "b#fwd", "c"]), (2, ["a"])], "od_id long, path array<string>")
    assert rows(routes.path_metrics(paths, nodes)) == [(1, 11.0, 3), (2, 0.0, 1)]


def test_many_incidents_in_one_place_are_served_in_turn(spark):
    draw = random.Random(4)
    fleet = [(v, draw.choice(["ambulance", "police", "car"]), float(draw.randrange(100)), float(draw.randrange(3)), draw.choice([1, 2, None]), v % 9 > 0, v % 7 == 0) for v in range(900)]
    incidents = [(k, k // 7, 50.0, 1.0, 1 + k % 5 // 4) for k in range(1500)] + [(5000, 0, 0.0, 0.0, None)]
    wanted = [(k, t, 1 + k % 3) for k, *_ in incidents for t in ("ambulance", "police", "car")] + [(3, "firetruck", 1), (4, "ambulance", 0)]
    free, want = {v[0]: v for v in fleet if v[5] and not v[6]}, {}
    for k, t, x, y, part in sorted(incidents, key=lambda i: (i[1], i[0])):
        for incident, kind, n in wanted:
            if incident == k and kind != "car" and n:
                near = sorted(((v[2] - x) ** 2 + (v[3] - y) ** 2, v[0]) for v in free.values() if v[1] == kind and v[4] == part and part)[:n]
                want[k, kind] = (n, [v for _, v in near], n - len(near))
                for _, v in near:
                    del free[v]
    got = telemetry.dispatch_nearest(
        spark.createDataFrame(incidents, "incident_id long, t long, x double, y double, part int").repartition(3), spark.createDataFrame(wanted, "incident_id long, type string, n int"),
        spark.createDataFrame(fleet, "vehicle_id long, vehicle_type string, x double, y double, part int, active boolean, responding boolean"),
    )
    assert {(r.incident_id, r.type): (r.requested, r.vehicle_ids, r.shortfall) for r in got.collect()} == want
