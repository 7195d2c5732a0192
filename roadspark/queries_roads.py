"""Registered queries: cut ways, endpoints in mid-road, signal plans, admissions, positions, dispatches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadspark.operators import cuts as K
from roadspark.operators import endpoints as N
from roadspark.operators import graph as G
from roadspark.operators import signals as L
from roadspark.operators import telemetry as V
from roadspark.plans import fixtures as X
from roadspark.plans.store import stored
from roadspark.queries import query, r4
from roadspark.queries_more import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]


def _points(s, d):
    """Every fix and the street of the grid row that it lies in."""
    return X.fixes(s, d).selectExpr("event_id AS point_id", "concat('h', CAST(floor(y / 60) AS BIGINT)) AS way_id", "x", "y")


_PLACED = """i AS (SELECT event_id AS point_id, 'h' || CAST(floor(y / 60) AS BIGINT) AS way_id, x, y FROM fx),
    c AS (SELECT i.point_id, way_id, i.x, i.y, seg.seq, seg.n, na, nb, ax, ay, zx, zy, d AS len, greatest(0, least(1, ((i.x - ax) * (zx - ax) + (i.y - ay) * (zy - ay)) / (d * d))) AS u FROM i JOIN seg USING (way_id)),
    o AS (SELECT *, round(sqrt((x - ax - u * (zx - ax))^2 + (y - ay - u * (zy - ay))^2), 9) AS near FROM c),
    pl AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY near, seq) = 1)"""
_CUTS = (
    _PLACED
    + """, q AS (SELECT *, CASE WHEN u <= 1e-4 THEN seq WHEN u >= 1 - 1e-4 THEN seq + 1 ELSE seq + u END AS pos, u <= 1e-4 OR u >= 1 - 1e-4 AS old FROM pl),
    k AS (SELECT *, pos - lag(pos) OVER (PARTITION BY way_id ORDER BY pos, point_id) AS gap FROM q WHERE pos > 0 AND pos < n - 1),
    ct AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY pos, point_id) AS p FROM k WHERE gap IS NULL OR gap > 1e-4)"""
)


@query("split_ways_at_points", f"""WITH {_CUTS}, m AS (SELECT way_id, pos, 1 AS cut FROM ct UNION ALL SELECT way_id, seq, 0 FROM wn WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.way_id = wn.way_id AND old AND pos = wn.seq)),
    z AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM m),
    b AS (SELECT way_id, piece FROM z UNION ALL SELECT way_id, piece + 1 FROM z WHERE cut = 1)
    SELECT way_id || CASE WHEN piece > 0 THEN '_c' || CAST(piece AS BIGINT) ELSE '' END AS way_id, count(*) AS nodes FROM b GROUP BY way_id, piece""")
def split_ways_at_points(s, d):
    return K.split_ways_at_points(X.ways(s, d), X.nodes(s, d), _points(s, d))[0].select("way_id", F.size("nodes").cast("long").alias("nodes"))


@query("shape_ways_at_points", f"WITH {_PLACED}, a AS (SELECT way_id, seq + u AS pos, point_id FROM pl WHERE u > 1e-4 AND u < 1 - 1e-4), k AS (SELECT *, pos - lag(pos) OVER (PARTITION BY way_id ORDER BY pos, point_id) AS gap FROM a) SELECT way_id, count(*) AS nodes FROM (SELECT way_id FROM k WHERE gap IS NULL OR gap > 1e-4 UNION ALL SELECT way_id FROM wn) GROUP BY way_id")
def shape_ways_at_points(s, d):
    return K.split_ways_at_points(X.ways(s, d), X.nodes(s, d), _points(s, d), split=False)[0].select("way_id", F.size("nodes").cast("long").alias("nodes"))


@query("midblock_signals", f"""WITH {_CUTS} SELECT point_id, CASE WHEN CASE WHEN oneway = 'yes' THEN true WHEN oneway = '-1' THEN false ELSE (zx - ax) * (y - ay) - (zy - ay) * (x - ax) > 0 END THEN way_id || CASE WHEN p > 1 THEN '_c' || (p - 1) ELSE '' END ELSE way_id || '_c' || p END AS lit_way_id FROM ct JOIN w USING (way_id)""")
def midblock_signals(s, d):
    return K.midblock_signals(X.ways(s, d), X.nodes(s, d), _points(s, d))[2].select("point_id", "lit_way_id")


def _crossing_ways(s, d):
    """The streets as they are, and the avenues over nodes of their own, moved by (20, 20)."""
    ways = X.ways(s, d)
    moved = X.nodes(s, d).withColumns({"node_id": F.concat(F.lit("m"), "node_id"), "x": F.col("x") + 20, "y": F.col("y") + 20})
    apart = F.when(F.col("way_id").startswith("v"), F.transform("nodes", lambda n: F.concat(F.lit("m"), n))).otherwise(F.col("nodes"))
    return ways.withColumn("nodes", apart), X.nodes(s, d).unionByName(moved)


@query("connect_crossings", """WITH e AS (SELECT way_id, seq, n, CASE WHEN way_id LIKE 'v%' THEN 20 ELSE 0 END AS o, ax + o AS ax, ay + o AS ay, zx - seg.ax AS rx, zy - seg.ay AS ry FROM seg),
    p AS (SELECT a.way_id AS wa, b.way_id AS wb, a.seq AS sa, b.seq AS sb, a.n AS na, b.n AS nb, ((b.ax - a.ax) * b.ry - (b.ay - a.ay) * b.rx) / (a.rx * b.ry - a.ry * b.rx) AS t, ((b.ax - a.ax) * a.ry - (b.ay - a.ay) * a.rx) / (a.rx * b.ry - a.ry * b.rx) AS u FROM e a JOIN e b ON a.way_id < b.way_id WHERE a.rx * b.ry - a.ry * b.rx <> 0),
    h AS (SELECT wa AS way_id, sa + t AS pos, na AS n FROM p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION ALL SELECT wb, sb + u, nb FROM p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
    r AS (SELECT DISTINCT way_id, n, CASE WHEN abs(pos - round(pos)) <= 1e-4 THEN round(pos) ELSE pos END AS pos FROM h),
    k AS (SELECT way_id, count(*) FILTER (pos > 0 AND pos < n - 1) AS cuts, count(*) FILTER (pos <> round(pos)) AS fresh FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY way_id ORDER BY pos) AS gap FROM r) WHERE gap IS NULL OR gap > 1e-4 GROUP BY way_id)
    SELECT w.way_id, 1 + coalesce(cuts, 0) AS pieces, w.n + coalesce(cuts, 0) + coalesce(fresh, 0) AS nodes FROM w LEFT JOIN k USING (way_id)""")
def connect_crossings(s, d):
    made, _ = K.connect_crossings(*_crossing_ways(s, d))
    return made.groupBy(F.regexp_replace("way_id", "_c.*$", "").alias("way_id")).agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.size("nodes")).alias("nodes"))


_ENDS = f"""{_PLACED}, ve AS (SELECT point_id, way_id, na AS node_a, nb AS node_b, u * len / (kmh / 3.6) AS to_a, (1 - u) * len / (kmh / 3.6) AS to_b, coalesce(divider, '') = 'yes' AND coalesce(oneway, '') <> 'yes' AS split,
    CASE WHEN fwd AND NOT bwd THEN 'AtoB' WHEN bwd AND NOT fwd THEN 'BtoA' WHEN coalesce(divider, '') = 'yes' AND coalesce(oneway, '') <> 'yes' THEN CASE WHEN (zx - ax) * (y - ay) - (zy - ay) * (x - ax) >= 0 THEN 'AtoB' ELSE 'BtoA' END ELSE 'both' END AS directions,
    ax + u * (zx - ax) AS px, ay + u * (zy - ay) AS py, (zx - ax) / len AS dx, (zy - ay) / len AS dy, CASE WHEN lanes = '4' THEN 3.2 ELSE 1.6 END::DOUBLE AS aside FROM pl JOIN ws USING (way_id))"""


@query("virtual_endpoints", f"WITH {_ENDS} SELECT point_id, node_a, node_b, round(to_a, 4) AS to_a_sec, round(to_b, 4) AS to_b_sec, directions, round(px - CASE WHEN split THEN dy * aside * CASE directions WHEN 'AtoB' THEN 1 ELSE -1 END ELSE 0 END, 3) AS x, round(py + CASE WHEN split THEN dx * aside * CASE directions WHEN 'AtoB' THEN 1 ELSE -1 END ELSE 0 END, 3) AS y FROM ve")
def virtual_endpoints(s, d):
    return N.virtual_endpoints(_points(s, d), X.ways(s, d), X.nodes(s, d)).select("point_id", "node_a", "node_b", *r4("to_a_sec", "to_b_sec"), "directions", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _endpoints(s, d):
    """Fixes in mid-road, and every node of the grid by its own name under a negative number."""
    mid = N.virtual_endpoints(_points(s, d), X.ways(s, d), X.nodes(s, d)).withColumn("node_id", F.lit(None).cast("string"))
    return mid.unionByName(X.grid(s, d).selectExpr("-1 - k AS point_id", "concat('n', k) AS node_id"), allowMissingColumns=True)


@query("endpoint_seeds", f"""WITH {_ENDS}, ids AS (SELECT src AS id FROM edge UNION SELECT dst FROM edge), known AS (SELECT DISTINCT split_part(id, '#', 1) AS id FROM ids), role(start_) AS (VALUES (true), (false)),
    v AS (SELECT * FROM ve, role WHERE node_a IN (SELECT id FROM known) AND node_b IN (SELECT id FROM known)),
    t AS (SELECT start_, point_id, node_a AS p, node_a || CASE WHEN start_ THEN '#bwd' ELSE '#fwd' END AS q, to_a AS c FROM v WHERE directions IN ('both', CASE WHEN start_ THEN 'BtoA' ELSE 'AtoB' END) UNION ALL SELECT start_, point_id, node_b, node_b || CASE WHEN start_ THEN '#fwd' ELSE '#bwd' END, to_b FROM v WHERE directions IN ('both', CASE WHEN start_ THEN 'AtoB' ELSE 'BtoA' END))
    SELECT start_ AS start, point_id, CASE WHEN q IN (SELECT id FROM ids) THEN q ELSE p END AS node_id, round(c, 4) AS cost_sec FROM t UNION ALL SELECT start_, -1 - k, id, 0 FROM nd JOIN ids ON split_part(id, '#', 1) = node_id, role""")
def endpoint_seeds(s, d):
    ends, edges = stored(_endpoints(s, d), "ends"), stored(G.routing_edges(X.nodes(s, d), X.ways(s, d)), "edges")
    each = lambda start: N.endpoint_seeds(ends, edges, start).select(F.lit(start).alias("start"), "point_id", "node_id", *r4("cost_sec"))
    return each(True).unionByName(each(False))


@query("same_edge_direct", f"WITH {_ENDS} SELECT a.point_id AS od_id, round(abs(a.to_a - b.to_a), 4) AS cost_sec FROM (SELECT *, lead(point_id) OVER (PARTITION BY node_a, node_b ORDER BY point_id) AS nxt FROM ve) a JOIN ve b ON b.point_id = a.nxt WHERE a.directions = 'both' OR (b.to_b < a.to_b AND a.directions = 'AtoB') OR (b.to_b >= a.to_b AND a.directions = 'BtoA')")
def same_edge_direct(s, d):
    """From every fix to the next one on the same segment."""
    ends = stored(N.virtual_endpoints(_points(s, d), X.ways(s, d), X.nodes(s, d)), "ends")
    od = ends.select(F.col("point_id").alias("od_id"), F.col("point_id").alias("start_id"), F.lead("point_id").over(Window.partitionBy("node_a", "node_b").orderBy("point_id")).alias("end_id"))
    return N.same_edge_direct(od, ends).select("od_id", *r4("cost_sec"))


_LEGS = "a AS (SELECT l_orderkey AS j, 'w' || l_linenumber AS way_id, radians((l_partkey * 37 + l_linenumber * 61) % 360)::DOUBLE AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY radians((l_partkey * 37 + l_linenumber * 61) % 360)::DOUBLE, 'w' || l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _legs(s, d):
    """The lines of an order as the legs of a junction."""
    return s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS junction_id", "concat('w', l_linenumber) AS way_id", "radians(CAST((l_partkey * 37 + l_linenumber * 61) % 360 AS DOUBLE)) AS bearing")


def _plan_rows(plans):
    groups = F.when(F.col("scheme") == "paired4way", F.col("paired.pairs.wayIds")).otherwise(F.col("phases.wayIds"))
    return plans.select("node_id", "scheme", F.array_join(F.transform(groups, lambda g: F.array_join(g, "+")), " ").alias("groups"))


_PLAN = f"""WITH {_LEGS}, l AS (SELECT j, list(way_id ORDER BY i) AS w, list(b ORDER BY i) AS b, any_value(n) AS n FROM a GROUP BY j),
    t AS (SELECT *, CASE WHEN n = 3 THEN list_transform([[1, 2], [1, 3], [2, 3]], lambda p: round(CASE WHEN abs(b[p[1]] - b[p[2]]) > pi() THEN 2 * pi() - abs(b[p[1]] - b[p[2]]) ELSE abs(b[p[1]] - b[p[2]]) END, 9)) END AS f FROM l)
    SELECT j AS node_id, CASE WHEN n = 4 THEN '{{four}}' ELSE 'phases' END AS scheme, CASE WHEN n = 4 THEN w[1] || '+' || w[3] || ' ' || w[2] || '+' || w[4] WHEN n <> 3 THEN array_to_string(w, ' ') WHEN f[1] >= f[2] AND f[1] >= f[3] THEN w[1] || '+' || w[2] || ' ' || w[3] WHEN f[2] >= f[3] THEN w[1] || '+' || w[3] || ' ' || w[2] ELSE w[2] || '+' || w[3] || ' ' || w[1] END AS groups FROM t"""


@query("signal_plans", _PLAN.replace("{four}", "paired4way"))
def signal_plans(s, d):
    return _plan_rows(L.signal_plans(_legs(s, d)))


@query("signal_plans_phases", _PLAN.replace("{four}", "phases"))
def signal_plans_phases(s, d):
    return _plan_rows(L.signal_plans(_legs(s, d), paired=False))


_MOVES = "mv AS (SELECT DISTINCT l_orderkey AS j, CAST(l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS id, l_linenumber AS ln, 'w' || (l_partkey % 4) AS fw, 'w' || (l_suppkey % 4) AS tw, (['through','right','uturn'])[CAST(l_linenumber % 3 AS INT) + 1] AS m, ([1.0, 0.0, -1.0, 0.0])[CAST(l_partkey % 4 AS INT) + 1]::DOUBLE AS ax, ([0.0, 1.0, 0.0, -1.0])[CAST(l_partkey % 4 AS INT) + 1]::DOUBLE AS ay, CAST(l_quantity AS BIGINT) % 5 AS rank, l_suppkey % 10 AS arrived FROM lineitem)"
_AGREE = "({a}.fw = {b}.fw OR ({a}.m = {b}.m AND {a}.ax * {b}.ax + {a}.ay * {b}.ay < -0.7 AND ({a}.m = 'through' OR ({a}.m = 'right' AND {a}.tw <> {b}.tw))))"


def _moves(s, d):
    """The lines of an order as movements that wait at one junction."""
    return s.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "0L AS t", "l_orderkey AS junction_id", "CAST(l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS vehicle_id", "l_linenumber AS line", "concat('w', l_partkey % 4) AS from_way", "concat('w', l_suppkey % 4) AS to_way", "element_at(array('through','right','uturn'), CAST(l_linenumber % 3 AS INT) + 1) AS movement",
        "element_at(array(1.0D, 0.0D, -1.0D, 0.0D), CAST(l_partkey % 4 AS INT) + 1) AS arr_x", "element_at(array(0.0D, 1.0D, 0.0D, -1.0D), CAST(l_partkey % 4 AS INT) + 1) AS arr_y", "CAST(l_quantity AS BIGINT) % 5 AS rank", "l_suppkey % 10 AS arrived",
    ).distinct()


@query("admit_movements", f"""WITH {_MOVES}, cd AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY rank DESC, arrived, id) AS k FROM mv WHERE ln < 6),
    ok AS (SELECT * FROM cd WHERE NOT EXISTS (SELECT 1 FROM mv f WHERE f.j = cd.j AND f.ln >= 6 AND NOT {_AGREE.format(a='cd', b='f')})),
    r(j, k, won) AS (SELECT DISTINCT j, 0::BIGINT, CAST([] AS STRUCT(id BIGINT, fw VARCHAR, tw VARCHAR, m VARCHAR, ax DOUBLE, ay DOUBLE)[]) FROM cd UNION ALL SELECT r.j, r.k + 1, CASE WHEN ok.id IS NOT NULL AND len(list_filter(r.won, lambda o: NOT {_AGREE.format(a='ok', b='o')})) = 0 THEN list_append(r.won, {{'id': ok.id::BIGINT, 'fw': ok.fw, 'tw': ok.tw, 'm': ok.m, 'ax': ok.ax, 'ay': ok.ay}}) ELSE r.won END FROM r LEFT JOIN ok ON ok.j = r.j AND ok.k = r.k + 1 WHERE r.k < (SELECT max(k) FROM cd))
    SELECT cd.j AS junction_id, cd.id AS vehicle_id, list_contains(list_transform(r.won, lambda o: o.id), cd.id::BIGINT) AS accepted FROM cd JOIN r ON r.j = cd.j AND r.k = (SELECT max(k) FROM cd)""", recursive=True)
def admit_movements(s, d):
    m = _moves(s, d)
    return L.admit_movements(m.where("line < 6"), m.where("line >= 6")).select("junction_id", "vehicle_id", "accepted")


@query("preempt_lamps", f"""WITH {_MOVES}, la AS (SELECT *, (['green','yellow','red'])[CAST(rank % 3 AS INT) + 1] AS color FROM mv)
    SELECT la.j AS junction_id, la.id AS vehicle_id, CASE WHEN e.j IS NULL THEN color WHEN e.fw = la.fw THEN 'green' WHEN la.j % 3 = 1 THEN CASE color WHEN 'green' THEN 'yellow' ELSE color END WHEN {_AGREE.format(a='e', b='la')} THEN color ELSE 'red' END AS color FROM la LEFT JOIN (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY j ORDER BY id) = 1) e ON e.j = la.j AND e.j % 3 > 0""")
def preempt_lamps(s, d):
    lamps = _moves(s, d).withColumn("color", F.expr("element_at(array('green','yellow','red'), CAST(rank % 3 AS INT) + 1)"))
    first = _moves(s, d).withColumn("n", F.row_number().over(Window.partitionBy("junction_id").orderBy("vehicle_id")))
    episodes = first.where("n = 1 and junction_id % 3 > 0").withColumn("clearing", F.col("junction_id") % 3 == 1)
    return L.preempt_lamps(lamps, episodes).select("junction_id", "vehicle_id", "color")


@query("vehicle_world_position", """WITH q AS (SELECT o_orderkey AS id, o_orderkey % 3 > 0 AS j, (o_custkey % 50)::DOUBLE AS ax, (o_custkey % 37)::DOUBLE AS ay, (o_custkey % 50 + o_orderkey % 11 - 5)::DOUBLE AS bx, (o_custkey % 37 + o_orderkey % 13 - 6)::DOUBLE AS zy, radians((o_custkey % 8) * 45) AS p, radians((o_orderkey % 8) * 45) AS r, 1 + o_orderkey % 3 AS n, o_custkey % 2 AS lane, (o_orderkey % 7)::DOUBLE AS dist FROM orders),
    a AS (SELECT *, bx - ax AS ex, zy - ay AS ey, sqrt((bx - ax)^2 + (zy - ay)^2) AS len, cos(p) * sin(r) - sin(p) * cos(r) AS det FROM q), b AS (SELECT *, CASE WHEN len > 1e-6 THEN least(1, dist / len) ELSE 0 END AS u, CASE WHEN j AND abs(det) > 1e-6 THEN (ex * sin(r) - ey * cos(r)) / det END AS s FROM a),
    c AS (SELECT *, coalesce(s > 0.05 AND s < greatest(1, 3 * len), false) AS bent, ax + cos(p) * s AS mx, ay + sin(p) * s AS my FROM b), e AS (SELECT *, 2 * (1 - u) * (mx - ax) + 2 * u * (bx - mx) AS tx, 2 * (1 - u) * (my - ay) + 2 * u * (zy - my) AS ty FROM c)
    SELECT id AS vehicle_id, round(CASE WHEN bent THEN (1 - u)^2 * ax + 2 * (1 - u) * u * mx + u^2 * bx ELSE ax + ex * u END, 4) + 0 AS x, round(CASE WHEN bent THEN (1 - u)^2 * ay + 2 * (1 - u) * u * my + u^2 * zy ELSE ay + ey * u END, 4) + 0 AS y,
    round(cos(CASE WHEN bent AND sqrt(tx^2 + ty^2) > 1e-6 THEN atan2(ty, tx) ELSE atan2(ey, ex) END), 3) + 0 AS heading_x, round(CASE WHEN j THEN 0 ELSE 1.6 + ((least(n, 2) - 1) / 2.0 - least(lane, least(n, 2) - 1)) * 3.2 END::DOUBLE, 3) AS lateral_m FROM e""")
def vehicle_world_position(s, d):
    q = s.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey AS vehicle_id", "0L AS t", "o_orderkey AS edge_id", "o_orderkey % 3 > 0 AS is_junction", "CAST(o_custkey % 50 AS DOUBLE) AS ax", "CAST(o_custkey % 37 AS DOUBLE) AS ay", "CAST(o_custkey % 50 + o_orderkey % 11 - 5 AS DOUBLE) AS bx", "CAST(o_custkey % 37 + o_orderkey % 13 - 6 AS DOUBLE) AS by",
        "radians((o_custkey % 8) * 45) AS p", "radians((o_orderkey % 8) * 45) AS r", "1 + o_orderkey % 3 AS lanes_per_direction", "o_custkey % 2 AS lane", "CAST(o_orderkey % 7 AS DOUBLE) AS dist", "3.2D AS lane_width", "1.6D AS offset_m",
    ).selectExpr("*", "cos(p) AS arr_x", "sin(p) AS arr_y", "cos(r) AS dep_x", "sin(r) AS dep_y", "sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS length_m")
    edges = q.drop("vehicle_id", "t", "lane", "dist", "p", "r")
    return V.vehicle_world_position(q, edges).select("vehicle_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("x", "y")), (F.round(F.cos("heading"), 3) + 0.0).alias("heading_x"), F.round("lateral_m", 3).alias("lateral_m"))


@query("live_route", f"""WITH {_MOVES}, je AS (SELECT 'x' || j || '_' || id AS edge_id, 'w' || (j % 500) AS src, m, (id * 2)::DOUBLE AS len FROM mv), on_ AS (SELECT event_id AS id, 'e' || (user_id % 700) AS edge_id, 'w' || (user_id % 700) AS dst FROM events),
    nx AS (SELECT src, arg_min(edge_id, (m <> 'through', edge_id)) AS e, arg_min(len, (m <> 'through', edge_id)) AS l FROM je GROUP BY src)
    SELECT id, 0 AS step, edge_id, false AS is_junction, 9.0::DOUBLE AS length_m FROM on_ UNION ALL SELECT id, 1, e, true, l FROM on_ JOIN nx ON src = dst""")
def live_route(s, d):
    """Fixes on one edge for each of 700, whose ends 500 groups of junction edges leave."""
    cross = _moves(s, d).selectExpr("concat('x', junction_id, '_', vehicle_id) AS edge_id", "concat('w', junction_id % 500) AS src", "movement", "CAST(vehicle_id * 2 AS DOUBLE) AS length_m")
    snaps = s.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS id", "concat('e', user_id % 700) AS edge_id", "concat('w', user_id % 700) AS dst", "9.0D AS length_m")
    return V.live_route(snaps, snaps.select("edge_id", "dst", "length_m").distinct(), cross)


@query("dispatch_nearest", f"""WITH q AS (SELECT incident_id, t, x, y, incident_id % 3 AS part, type, 1 + incident_id % 2 AS n, row_number() OVER (PARTITION BY type ORDER BY t, incident_id) AS k FROM inc, (VALUES ('ambulance'), ('firetruck'), ('police')) AS z(type)),
    v AS (SELECT k AS vehicle_id, x, y, k % 3 AS part, (['car','motorcycle','bus','truck','ambulance','firetruck','police'])[CAST(k % 7 AS INT) + 1] AS type FROM nd WHERE k % 10 <> 0 AND k % 11 <> 0),
    c AS MATERIALIZED (SELECT q.type, q.k, q.n, coalesce(list(v.vehicle_id ORDER BY (q.x - v.x)^2 + (q.y - v.y)^2, v.vehicle_id) FILTER (v.vehicle_id IS NOT NULL), []) AS near FROM q LEFT JOIN v ON v.type = q.type AND v.part = q.part GROUP BY q.type, q.k, q.n),
    r(type, k, taken, sent) AS (SELECT DISTINCT type, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM q UNION ALL SELECT s.type, s.k, s.taken || s.p, s.p FROM (SELECT r.type, r.k + 1 AS k, r.taken, list_filter(c.near, lambda z: NOT list_contains(r.taken, z))[1:c.n] AS p FROM r JOIN c ON c.type = r.type AND c.k = r.k + 1) s)
    SELECT q.incident_id, q.type, q.n AS requested, array_to_string(r.sent, ',') AS vehicle_ids, q.n - len(r.sent) AS shortfall FROM q JOIN r USING (type, k)""", recursive=True)
def dispatch_nearest(s, d):
    """Every error as an incident that wants one or two vehicles of each emergency type."""
    inc = X.incidents(s, d).withColumn("part", F.col("incident_id") % 3)
    kinds = F.explode(F.array(*map(F.lit, ("ambulance", "firetruck", "police", "car"))))
    wanted = inc.select("incident_id", kinds.alias("type"), (1 + F.col("incident_id") % 2).alias("n"))
    fleet = X.grid(s, d).selectExpr("k AS vehicle_id", "element_at(array('car','motorcycle','bus','truck','ambulance','firetruck','police'), CAST(k % 7 AS INT) + 1) AS vehicle_type", "x", "y", "k % 3 AS part", "k % 10 <> 0 AS active", "k % 11 = 0 AS responding")
    return V.dispatch_nearest(inc, wanted, fleet).withColumn("vehicle_ids", F.array_join(F.col("vehicle_ids").cast("array<string>"), ","))
