"""More registered queries: edits, routes, registry tables, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadspark.operators import edits as E
from roadspark.operators import graph as G
from roadspark.operators import mapbuild as M
from roadspark.operators import registry as R
from roadspark.operators import routes as P
from roadspark.plans import fixtures as X
from roadspark.plans.store import shared_dir
from roadspark.queries import ORACLE_SQL, QUERIES, query, r4
from roadspark.sources import files as S
from roadspark.streaming import live as W

__all__ = ["ORACLE_SQL", "QUERIES"]


def _features(s, d):
    """Avenues closed to rings as footprints, and nodes of which some are amenities."""
    ways = X.ways(s, d).where("way_id like 'v%'").withColumns({"tags": F.when(F.col("ord") % 2 == 0, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map(F.lit("amenity"), F.lit("school"))), "nodes": F.concat("nodes", F.slice("nodes", 1, 1))})
    some = F.substring("node_id", 2, 20).cast("long") % 50 == 3
    return ways, X.nodes(s, d).withColumn("tags", F.when(some, F.create_map(F.lit("amenity"), F.lit("cafe"))).otherwise(F.col("tags")))


@query("extract_buildings", "SELECT 'b_' || way_id AS building_id, count(*) AS corners FROM wn WHERE way_id LIKE 'v%' AND n >= 3 GROUP BY way_id UNION ALL SELECT 'bn_' || node_id, 4 FROM nd WHERE k % 50 = 3")
def extract_buildings(s, d):
    return E.extract_buildings(*_features(s, d)).select("building_id", F.size("polygon").cast("long").alias("corners"))


@query("extract_amenities", "SELECT 'a_' || way_id || '_c' AS amenity_id, round(avg(x), 1) AS x, round(avg(y), 1) AS y FROM wn JOIN w USING (way_id) WHERE way_id LIKE 'v%' AND wn.n >= 3 AND ord % 2 = 1 GROUP BY way_id UNION ALL SELECT 'a_' || node_id, round(x, 1), round(y, 1) FROM nd WHERE k % 50 = 3")
def extract_amenities(s, d):
    return E.extract_amenities(*_features(s, d)).select("amenity_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query("remap_nodes", """WITH m AS (SELECT way_id, seq, CASE WHEN CAST(substr(node_id, 2) AS BIGINT) % 3 = 1 THEN 'n' || (CAST(substr(node_id, 2) AS BIGINT) - 1) ELSE node_id END AS node_id FROM wn), l AS (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS p FROM m)
    SELECT way_id, string_agg(node_id, ',' ORDER BY seq) AS nodes FROM l WHERE p IS NULL OR p <> node_id GROUP BY way_id HAVING count(*) >= 2""")
def remap_nodes(s, d):
    n = X.nodes(s, d)
    k = F.substring("node_id", 2, 20).cast("long")
    mapping = n.where(k % 3 == 1).select(F.col("node_id").alias("from_id"), F.concat(F.lit("n"), k - 1).alias("into_id"))
    return E.remap_nodes(n, X.ways(s, d), mapping)[1].select("way_id", F.array_join("nodes", ",").alias("nodes"))


@query("affine_move", "SELECT node_id, round(CASE WHEN k % 7 = 0 THEN 100 - (y - 50) + 5 ELSE x END, 4) AS x, round(CASE WHEN k % 7 = 0 THEN 50 + (x - 100) - 3 ELSE y END, 4) AS y FROM nd")
def affine_move(s, d):
    n = X.nodes(s, d)
    return E.affine_move(n, n.where(F.substring("node_id", 2, 20).cast("long") % 7 == 0), "node_id", 5.0, -3.0, (100.0, 50.0), 1.5707963267948966).select("node_id", *r4("x", "y"))


@query("cascade_delete", "WITH gone AS (SELECT 'b_' || p_partkey AS id FROM part WHERE p_partkey % 11 = 0 UNION SELECT building_id FROM am WHERE ord % 9 = 0 AND building_id IS NOT NULL) SELECT building_id AS id FROM bl WHERE building_id NOT IN (SELECT id FROM gone) UNION ALL SELECT amenity_id FROM am WHERE ord % 9 <> 0 AND (building_id IS NULL OR building_id NOT IN (SELECT id FROM gone))")
def cascade_delete(s, d):
    b, a = X.buildings(s, d), X.amenities(s, d)
    picked = b.where("ord % 11 = 0").select(F.lit("building").alias("kind"), F.col("building_id").alias("id")).unionByName(a.where("ord % 9 = 0").select(F.lit("amenity").alias("kind"), F.col("amenity_id").alias("id")))
    left, kept = E.cascade_delete(b, a, picked)
    return left.select(F.col("building_id").alias("id")).unionByName(kept.select(F.col("amenity_id").alias("id")))


@query("curve_points", """WITH p AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(y) OVER w, y) AS y0, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x2, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS y2 FROM wn WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    q AS (SELECT p.*, k, k / 8.0::DOUBLE AS t FROM p, range(0, 8) AS z(k) WHERE x1 IS NOT NULL OR k = 0)
    SELECT way_id, seq * 8 + k AS seq, round(CASE WHEN x1 IS NULL THEN x ELSE 0.5 * (2 * x + (x1 - x0) * t + (2 * x0 - 5 * x + 4 * x1 - x2) * t^2 + (3 * x - x0 - 3 * x1 + x2) * t^3) END, 3) AS x, round(CASE WHEN y1 IS NULL THEN y ELSE 0.5 * (2 * y + (y1 - y0) * t + (2 * y0 - 5 * y + 4 * y1 - y2) * t^2 + (3 * y - y0 - 3 * y1 + y2) * t^3) END, 3) AS y FROM q""")
def curve_points(s, d):
    return E.curve_points(X.ways(s, d), X.nodes(s, d)).select("way_id", F.col("seq").cast("long").alias("seq"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("snap_to_edge", """WITH e AS (SELECT way_id || ':' || seq || ':' || CASE WHEN f THEN 'f' ELSE 'b' END AS edge_id, CASE WHEN f THEN ax ELSE zx END AS ax, CASE WHEN f THEN ay ELSE zy END AS ay, CASE WHEN f THEN zx ELSE ax END AS bx, CASE WHEN f THEN zy ELSE ay END AS bz, d FROM seg JOIN rw USING (way_id), (VALUES (true), (false)) AS q(f) WHERE (f AND fwd) OR (NOT f AND bwd)),
    c AS (SELECT i.event_id AS id, e.*, i.x, i.y, ((i.heading::INT % 360) + 360) % 360 AS h, greatest(0, least(1, ((i.x - ax) * (bx - ax) + (i.y - ay) * (bz - ay)) / (d * d))) AS t FROM fx i, e WHERE i.x BETWEEN least(ax, bx) - 15 AND greatest(ax, bx) + 15 AND i.y BETWEEN least(ay, bz) - 15 AND greatest(ay, bz) + 15),
    o AS (SELECT *, sqrt((x - ax - t * (bx - ax))^2 + (y - ay - t * (bz - ay))^2) AS off, abs(h - ((degrees(atan2(bx - ax, bz - ay)) + 360) % 360)) AS turn FROM c),
    m AS (SELECT *, coalesce(CASE WHEN turn > 180 THEN 360 - turn ELSE turn END > 100, false) AS wrong FROM o WHERE off <= 15)
    SELECT id, arg_min(edge_id, (wrong, round(off, 6), edge_id)) AS edge_id, round(arg_min(off, (wrong, round(off, 6), edge_id)), 4) AS offset_m, arg_min(wrong, (wrong, round(off, 6), edge_id)) AS heading_mismatch FROM m GROUP BY id""")
def snap_to_edge(s, d):
    n = X.nodes(s, d).select("node_id", "x", "y")
    e = G.chain_edges(X.nodes(s, d), X.ways(s, d)).join(n.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")), "dst")
    p = X.fixes(s, d).select(F.col("event_id").alias("id"), "x", "y", F.pmod("heading_deg", F.lit(360.0)).alias("heading_deg"))
    return P.snap_to_edge(p, e.select("edge_id", "ax", "ay", "bx", "by", "length_m"), 15.0).select("id", "edge_id", *r4("offset_m"), "heading_mismatch")


@query("largest_scc", """WITH r(a, b) AS (SELECT src, src FROM edge UNION SELECT dst, dst FROM edge UNION SELECT r.a, dst FROM r JOIN edge ON r.b = edge.src),
    c AS (SELECT x.a, min(x.b) AS root FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a), n AS (SELECT root, count(*) AS n FROM c GROUP BY root)
    SELECT a AS node_id FROM c WHERE root = (SELECT root FROM n ORDER BY n DESC, root LIMIT 1)""", recursive=True)
def largest_scc(s, d):
    return P.largest_scc(G.routing_edges(X.nodes(s, d), X.ways(s, d)).select("src", "dst"))


@query("route_paths")
def route_paths(s, d):
    """Routes of all trips."""
    od = X.trips(s, d).select(F.col("trip_id").alias("od_id"), F.col("start_node").alias("src"), F.col("end_node").alias("dst"))
    return P.route_paths(G.routing_edges(X.nodes(s, d), X.ways(s, d)), od).select("od_id", "found", *r4("cost_sec"), F.size("path").alias("nodes"))


@query("route_steps", """SELECT way_id AS trip_id, count(*) AS steps, round(sum(d), 3) AS length_m FROM seg JOIN rw USING (way_id) WHERE fwd GROUP BY way_id""")
def route_steps(s, d):
    """Every way that may be driven forward, as a path over its own nodes."""
    ways = M.routable_ways(X.ways(s, d), X.nodes(s, d)).where("coalesce(tags['oneway'], '') <> '-1'")
    cross = s.createDataFrame([], "src string, dst string, length_m double")
    steps, _ = P.route_steps(ways.select(F.col("way_id").alias("trip_id"), F.col("nodes").alias("path")), G.chain_edges(X.nodes(s, d), X.ways(s, d)), cross)
    return steps.groupBy("trip_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("length_m"), 3).alias("length_m"))


@query("desired_lane", """WITH q AS (SELECT o_orderkey // 10 AS trip_id, o_orderkey % 10 AS step, o_orderkey % 3 = 2 AS j, (['through','right','uturn'])[CAST(o_custkey % 3 AS INT) + 1] AS m, 1 + o_custkey % 2 AS lanes FROM orders)
    SELECT trip_id, step, CASE WHEN lanes < 2 THEN 0 ELSE coalesce((SELECT (n.m <> 'through')::INT FROM q n WHERE n.trip_id = q.trip_id AND n.step > q.step AND n.j ORDER BY n.step LIMIT 1), 0) END AS lane FROM q WHERE NOT j""")
def desired_lane(s, d):
    q = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey div 10 AS trip_id", "o_orderkey % 10 AS step", "o_orderkey % 3 = 2 AS is_junction", "element_at(array('through','right','uturn'), CAST(o_custkey % 3 AS INT) + 1) AS movement", "1 + o_custkey % 2 AS lanes_per_direction")
    return P.desired_lane(q)


_REGISTRY = "em AS (SELECT c_custkey AS employee_id, c_nationkey AS employer_id, 'm' || (c_custkey % 1400) AS email FROM customer), eo AS (SELECT n_nationkey AS employer_id FROM nation WHERE n_nationkey < 24), ve AS (SELECT o_orderkey AS vehicle_id, o_custkey + 5 AS employee_id, CASE WHEN o_orderkey % 50 = 0 THEN 'boat' ELSE 'car' END AS vehicle_type FROM orders)"


def _registry(s, d):
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    return (
        t("customer").selectExpr("c_custkey AS employee_id", "c_nationkey AS employer_id", "concat('m', c_custkey % 1400) AS email", "'x' AS password_hash", "c_custkey AS created_at"),
        t("nation").selectExpr("n_nationkey AS employer_id").where("employer_id < 24"),
        t("orders").selectExpr("o_orderkey AS vehicle_id", "o_custkey + 5 AS employee_id", "CASE WHEN o_orderkey % 50 = 0 THEN 'boat' ELSE 'car' END AS vehicle_type"),
    )


@query("registry_listing", f"WITH {_REGISTRY} SELECT employee_id, employer_id, email, employee_id AS created_at FROM em WHERE employer_id IN (3, 5)")
def registry_listing(s, d):
    people, owners, _ = _registry(s, d)
    return R.registry_listing(people, "employer_id", owners.where("employer_id in (3, 5)"))


@query("active_sessions", "SELECT event_id AS session_id, CASE WHEN event_id % 1000 <= 300 THEN 'expired' WHEN user_id % 4 <> 0 AND user_id < (SELECT count(*) FROM customer) THEN 'active' ELSE 'rejected' END AS status FROM events")
def active_sessions(s, d):
    sessions = s.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS session_id", "'employee' AS subject_type", "user_id AS subject_id", "event_id % 1000 AS expires_at")
    people = s.read.parquet(f"{d}/customer.parquet").selectExpr("'employee' AS subject_type", "c_custkey AS subject_id", "c_custkey % 4 <> 0 AS active")
    return R.active_sessions(sessions, people, 300)


@query("registry_integrity", f"""WITH {_REGISTRY} SELECT 'employees' AS "table", 'unique email' AS rule, email AS key FROM em GROUP BY email HAVING count(*) > 1 UNION ALL SELECT 'employees', 'employer exists', employee_id::VARCHAR FROM em WHERE employer_id NOT IN (SELECT employer_id FROM eo)
    UNION ALL SELECT 'vehicles', 'employee exists', vehicle_id::VARCHAR FROM ve WHERE employee_id NOT IN (SELECT employee_id FROM em) UNION ALL SELECT 'vehicles', 'known type', vehicle_id::VARCHAR FROM ve WHERE vehicle_type = 'boat'""")
def registry_integrity(s, d):
    return R.registry_integrity(*_registry(s, d))


@query("parse_state_ticks", "SELECT t::DOUBLE AS t, 'v' || vehicle_id AS id, round(speed_mps, 4) AS speed_mps, vehicle_type AS type, vehicle_type IN ('ambulance', 'firetruck', 'police') AS emergency, speed_mps < 0.5 AS stuck FROM st")
def parse_state_ticks(s, d):
    emergency = F.when(F.col("vehicle_type").isin("ambulance", "firetruck", "police"), 1)
    v = F.struct(F.concat(F.lit("v"), "vehicle_id").alias("id"), F.col("dist").alias("x"), F.col("lane").cast("double").alias("y"), F.col("speed_mps").alias("s"), F.col("vehicle_type").alias("ty"), emergency.alias("em"), F.when(F.col("speed_mps") < 0.5, 1).alias("stk"))
    raw = X.states(s, d).groupBy("t").agg(F.collect_list(v).alias("vehicles")).select(F.to_json(F.struct(F.col("t").cast("double").alias("t"), "vehicles")).alias("value"))
    return S.parse_state_ticks(raw)[1].select("t", "id", *r4("speed_mps"), "type", "emergency", "stuck")


@query("trips_roundtrip", "SELECT trip_id AS id, vehicle_type AS \"vehicleType\", start_node AS \"startNodeId\", (CASE WHEN trip_id % 3 = 0 THEN 4.5 ELSE 3.0 + trip_id % 4 END)::DOUBLE AS length, 140.0::DOUBLE AS \"maxSpeedKmh\", CASE WHEN trip_id % 7 = 0 THEN 'a_1' END AS \"homeAmenityId\" FROM tr")
def trips_roundtrip(s, d):
    import uuid

    t = X.trips(s, d).selectExpr("trip_id AS id", "vehicle_type AS vehicleType", "start_node AS startNodeId", "end_node AS endNodeId", "CASE WHEN trip_id % 3 <> 0 THEN CAST(3 + trip_id % 4 AS DOUBLE) END AS length", "1.8D AS width", "CAST(NULL AS DOUBLE) AS maxSpeedKmh", "CASE WHEN trip_id % 7 = 0 THEN 'a_1' END AS homeAmenityId")
    path = f"{shared_dir(s)}/trips-{uuid.uuid4().hex}"
    S.write_trips(t, path, "csv")
    return S.read_trips(s, path, "csv").select("id", "vehicleType", "startNodeId", "length", "maxSpeedKmh", "homeAmenityId")


def _fix_stream(s, d):
    """events as a stream of fixes with dense time."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return raw.selectExpr("event_id", "concat('FV-', user_id) AS vehicle_id", "CAST((user_id * 131 + event_id * 17) % 2200 AS DOUBLE) AS x", "user_id % 50 AS edge", "CAST(value AS DOUBLE) % 60 AS speed_mps", "timestamp_seconds(1704067200 + event_id) AS ts")


@query("latest_position_stream", "SELECT DISTINCT ON (vehicle_id) vehicle_id, t, x FROM fx ORDER BY vehicle_id, t DESC")
def latest_position_stream(s, d):
    out = W.latest_position_stream(_fix_stream(s, d).withColumn("y", F.lit(0.0)))
    return W.run_once(out, shared_dir(s)).select("vehicle_id", (F.unix_seconds("ts") - 1704067200).alias("t"), "x")


@query("live_session_stream", """WITH f AS (SELECT vehicle_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY vehicle_id ORDER BY t) <= 20 THEN 0 ELSE 1 END AS n FROM fx), s AS (SELECT *, sum(n) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT vehicle_id, min(t) AS start, count(*) AS fixes FROM s GROUP BY vehicle_id, k""")
def live_session_stream(s, d):
    return W.run_once(W.live_session_stream(_fix_stream(s, d)), shared_dir(s)).select("vehicle_id", (F.unix_seconds("start") - 1704067200).alias("start"), "fixes")


@query("edge_window_stream", "SELECT user_id % 50 AS edge, z.s AS start, count(*) AS n, round(sum(value::DOUBLE % 60), 2) AS sum_mps FROM events JOIN range(-60, 1000000, 60) AS z(s) ON event_id >= s AND event_id < s + 120 GROUP BY ALL")
def edge_window_stream(s, d):
    out = W.edge_window_stream(_fix_stream(s, d), "120 seconds", "60 seconds")
    return W.run_once(out, shared_dir(s)).select("edge", (F.unix_seconds("start") - 1704067200).alias("start"), "n", F.round(F.col("avg_mps") * F.col("n"), 2).alias("sum_mps"))


@query("approaches", """WITH a AS (SELECT n.node_id AS junction_id, n.way_id, n.x, n.y, coalesce(f.x, b.x) AS ox, coalesce(f.y, b.y) AS oy, w.oneway, n.seq, n.n FROM wn n JOIN sg USING (node_id) JOIN w ON w.way_id = n.way_id LEFT JOIN wn f ON f.way_id = n.way_id AND f.seq = n.seq + 1 LEFT JOIN wn b ON b.way_id = n.way_id AND b.seq = n.seq - 1)
    SELECT junction_id, way_id, round(atan2(oy - y, ox - x), 4) AS bearing FROM a WHERE NOT (coalesce(oneway, '') = 'yes' AND seq = 0) AND NOT (coalesce(oneway, '') = '-1' AND seq = n - 1)""")
def approaches(s, d):
    from roadspark.operators.signals import approaches as run

    return run(X.signals(s, d), X.nodes(s, d), X.ways(s, d), incoming_only=True).select("junction_id", "way_id", *r4("bearing"))


@query("signal_groups_build", """WITH c AS (SELECT r, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM sg JOIN nd USING (node_id, r) GROUP BY r) SELECT 'g' || sg.r AS group_id, string_agg(node_id, ',' ORDER BY round(atan2(nd.x - cx, nd.y - cy), 9), node_id) AS members FROM sg JOIN nd USING (node_id) JOIN c ON c.r = sg.r WHERE n >= 2 GROUP BY sg.r""")
def signal_groups_build(s, d):
    from roadspark.operators.signals import signal_groups_build as run

    return run(X.nodes(s, d), X.signals(s, d), X.signals(s, d).select("group_id", "node_id")).select("group_id", F.array_join("member_ids", ",").alias("members"))


@query("lane_vision_cost", """WITH p AS (SELECT t, vehicle_id AS id, edge, lane, dist, speed_mps FROM st) SELECT a.t, a.id, a.lane, round(sum(greatest(0, a.speed_mps - b.speed_mps) * (1 - (b.dist - a.dist) / 50)), 4) AS cost FROM p a JOIN p b ON a.t = b.t AND a.edge = b.edge AND a.lane = b.lane AND b.dist > a.dist AND b.dist - a.dist < 50 GROUP BY ALL""")
def lane_vision_cost(s, d):
    from roadspark.operators.telemetry import lane_vision_cost as run

    return run(X.states(s, d)).select("t", "id", "lane", *r4("cost"))


@query("incident_lifecycle", """SELECT trip_id // 3 AS incident_id, CASE WHEN bool_and(completed) THEN 'resolved' ELSE 'responding' END AS status, min(spawn_t) AS t_responding FROM tr GROUP BY 1""")
def incident_lifecycle(s, d):
    from roadspark.operators.telemetry import incident_lifecycle as run

    t = X.trips(s, d)
    steps = F.array(F.struct(F.lit("dispatch").alias("event"), F.col("spawn_t").alias("t")), F.struct(F.when(F.col("completed"), "incident_arrival").alias("event"), (F.col("spawn_t") + F.col("duration")).alias("t")))
    e = t.select(F.col("trip_id").alias("vehicle_id"), F.expr("trip_id div 3").alias("incident_id"), F.explode(steps).alias("e")).select("vehicle_id", "incident_id", "e.event", "e.t").where("event is not null")
    return run(e.select("incident_id").distinct(), e).select("incident_id", "status", "t_responding")



_ONCE = "((({s} + {a} * 7919 + {b} * 104729 + {c} * 1299709) % 2147483648) * 1103515245 + 12345) % 2147483648"
_DRAW = f"(xor({_ONCE}, ({_ONCE}) >> 15) * 1103515245 + 12345) % 2147483648"
_PICK = [_DRAW.format(s=5, a="trip_id", b="t", c=k) for k in (0, 1)]


@query("sample_endpoints", f"""WITH o AS (SELECT node_id, x, y, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM nd), n AS (SELECT count(*) AS n FROM nd),
    p AS (SELECT trip_id AS id, t, ({_PICK[0]}) * n.n // 2147483648 AS i0, ({_PICK[1]}) * n.n // 2147483648 AS i1 FROM tr, range(0, 50) AS z(t), n),
    q AS (SELECT id, t, a.node_id AS s, b.node_id AS e, (a.x - b.x)^2 + (a.y - b.y)^2 >= 200 * 200 AS far FROM p JOIN o a ON a.idx = i0 JOIN o b ON b.idx = i1 WHERE i0 <> i1)
    SELECT id, coalesce(arg_min(s, t) FILTER (far), arg_max(s, t)) AS start_node, coalesce(arg_min(e, t) FILTER (far), arg_max(e, t)) AS end_node FROM q GROUP BY id""")
def sample_endpoints(s, d):
    from roadspark.operators.trips import sample_endpoints as run

    return run(X.trips(s, d).select(F.col("trip_id").alias("id")), X.nodes(s, d), 5, 200.0)


@query("vehicle_attributes", f"""SELECT trip_id AS id, vehicle_type AS type, CAST(16 + ({_DRAW.format(s=3, a='trip_id', b=9, c=0)}) * 65 // 2147483648 AS BIGINT) AS driver_age,
    round(CASE vehicle_type WHEN 'car' THEN 4.0 WHEN 'motorcycle' THEN 1.8 WHEN 'bus' THEN 7.0 WHEN 'truck' THEN 6.0 WHEN 'ambulance' THEN 5.5 WHEN 'firetruck' THEN 8.5 ELSE 4.5 END::DOUBLE + CASE vehicle_type WHEN 'car' THEN 5.1 - 4.0 WHEN 'motorcycle' THEN 2.3 - 1.8 WHEN 'bus' THEN 3.0 WHEN 'truck' THEN 6.0 WHEN 'ambulance' THEN 1.0 WHEN 'firetruck' THEN 2.5 ELSE 0.5 END::DOUBLE * (({_DRAW.format(s=3, a='trip_id', b=0, c=0)}) / 2147483648.0::DOUBLE), 2) AS length FROM tr""")
def vehicle_attributes(s, d):
    from roadspark.operators.trips import vehicle_attributes as run

    v = X.trips(s, d).select(F.col("trip_id").alias("id"), F.col("vehicle_type").alias("type"))
    return run(v, 3).select("id", "type", "driver_age", "length")


@query("response_time", f"""WITH v AS (SELECT trip_id AS id, vehicle_type AS type, 16 + trip_id % 65 AS age, -0.1 + 0.25 * (({_DRAW.format(s=3, a='trip_id', b=10, c=0)}) / 2147483648.0::DOUBLE) AS u FROM tr)
    SELECT id, round(greatest(0.35, least(2.0, CASE WHEN type IN ('ambulance', 'firetruck', 'police') THEN 0.55 ELSE 0.75 END + CASE WHEN age < 21 THEN 0.15 * (21 - age) / 5 WHEN age > 65 THEN 0.10 * (age - 65) / 10 ELSE 0 END + u))::DOUBLE, 3) AS response_time_sec FROM v""")
def response_time(s, d):
    from roadspark.operators.trips import response_time as run

    v = X.trips(s, d).selectExpr("trip_id AS id", "vehicle_type AS type", "16 + trip_id % 65 AS driver_age")
    return run(v, 3).select("id", "response_time_sec")


@query("queue_members", """WITH h AS (SELECT *, speed_mps < 0.5 AND t % 20 < 15 AND edge % 2 = 0 AS on_ FROM st), gq AS (SELECT *, t - row_number() OVER (PARTITION BY vehicle_id ORDER BY t) AS k FROM h WHERE on_)
    SELECT t, vehicle_id, min(t) OVER (PARTITION BY vehicle_id, k) AS since FROM gq""")
def queue_members(s, d):
    from roadspark.operators.telemetry import queue_members as run

    st = X.states(s, d)
    return run(st, st.where("t % 20 < 15 and edge % 2 = 0").select("t", "edge", "lane")).select("t", "vehicle_id", "since")


@query("signal_clock", """WITH hold AS (SELECT 'n' || (user_id % 500) AS node_id, event_id AS a, event_id + 3 + user_id % 40 AS b FROM events WHERE event_type = 'click'), ask AS (SELECT DISTINCT 'n' || (user_id % 500) AS node_id, event_id AS t FROM events),
    hf AS (SELECT *, max(b) OVER (PARTITION BY node_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hold), hg AS (SELECT *, sum(CASE WHEN before >= a THEN 0 ELSE 1 END) OVER (PARTITION BY node_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM hf),
    stop AS (SELECT node_id, k, min(a) AS a, max(b) AS b FROM hg GROUP BY node_id, k)
    SELECT ask.node_id, t, CAST(t - coalesce(sum(least(t, b) - a), 0) AS BIGINT) AS clock_sec FROM ask LEFT JOIN stop ON stop.node_id = ask.node_id AND a < t GROUP BY ask.node_id, t""")
def signal_clock(s, d):
    """Every click holds its node's clock for a while; the clock is asked for at every event."""
    from roadspark.operators.signals import signal_clock as run

    events = s.read.parquet(f"{d}/events.parquet")
    holds = events.where("event_type = 'click'").selectExpr("concat('n', user_id % 500) AS node_id", "event_id AS since", "event_id + 3 + user_id % 40 AS until")
    return run(holds, events.selectExpr("concat('n', user_id % 500) AS node_id", "event_id AS t").distinct())


@query("live_edge_cost", "SELECT way_id || ':' || seq || ':' || CASE WHEN f THEN 'f' ELSE 'b' END AS edge_id, round(d / greatest(2.0, CASE WHEN seq % 3 = 0 THEN seq % 7 ELSE mps END), 4) AS cost_sec FROM edge")
def live_edge_cost(s, d):
    from roadspark.operators.telemetry import live_edge_cost as run

    e = G.chain_edges(X.nodes(s, d), X.ways(s, d))
    seq = F.split("edge_id", ":")[1].cast("int")
    return run(e, e.where(seq % 3 == 0).select("edge_id", (seq % 7).cast("double").alias("live_mps"))).select("edge_id", *r4("cost_sec"))
