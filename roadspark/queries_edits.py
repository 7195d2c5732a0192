"""Registered queries: ways merged end to end and what names them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadspark.operators import chains as H
from roadspark.operators import edits
from roadspark.operators import joins as Q
from roadspark.plans import fixtures as X
from roadspark.plans.store import shared_dir
from roadspark.queries import query
from roadspark.queries_live import ORACLE_SQL, QUERIES
from roadspark.sources import mapjson as B

__all__ = ["ORACLE_SQL", "QUERIES"]


def _pieces(s, d):
    """(nodes, ways, signals): each street as one way per stretch, a third of them drawn backward; every third street closed to
    a ring, every third with dead ends; signals at some nodes."""
    g = X.grid(s, d).withColumns({"next": F.lead("k").over(Window.partitionBy("r").orderBy("col")), "last": F.max("k").over(Window.partitionBy("r")), "first": F.min("k").over(Window.partitionBy("r"))})
    row = "map('oneway', element_at(array('yes', '-1', 'no'), CAST(k % 3 AS INT) + 1)) AS tags"
    stretch = g.where("next IS NOT NULL").selectExpr("concat('h', r, '_', col) AS way_id", "(k * 37) % 1000 AS ord", row, "IF(k % 3 = 0, array(concat('n', next), concat('n', k)), array(concat('n', k), concat('n', next))) AS nodes")
    ring = g.where("k = first AND first < last AND r % 3 = 2").selectExpr("concat('ring', r) AS way_id", "2000 + k AS ord", row, "array(concat('n', last), concat('n', first)) AS nodes")
    stub = g.where("r % 3 = 1 AND k % 7 = 3").selectExpr("concat('s', k) AS way_id", "3000 + k AS ord", row, "array(concat('n', k), concat('x', k)) AS nodes")
    nodes = X.nodes(s, d).select("node_id", "tags")
    ends = stub.selectExpr("nodes[1] AS node_id", "CAST(map() AS map<string,string>) AS tags")
    lamps = X.signals(s, d).selectExpr("node_id", "array(named_struct('id', 'p0', 'wayIds', array(concat('h', r, '_', col - 1), concat('h', r, '_', col))), named_struct('id', 'p1', 'wayIds', array(concat('h', r + 1, '_', col), concat('v', col), concat('h', r + 1, '_', col + 1)))) AS phases")
    return nodes.unionByName(ends), stretch.unionByName(ring).unionByName(stub), lamps


_MERGED = """WITH g2 AS (SELECT *, lead(k) OVER (PARTITION BY r ORDER BY col) AS nx, max(k) OVER (PARTITION BY r) AS z, min(k) OVER (PARTITION BY r) AS f, (['yes', '-1', 'no'])[CAST(k % 3 AS INT) + 1] AS oneway FROM g),
    pc AS (SELECT 'h' || r || '_' || col AS way_id, (k * 37) % 1000 AS ord, oneway, 'n' || CASE WHEN k % 3 = 0 THEN nx ELSE k END AS a, 'n' || CASE WHEN k % 3 = 0 THEN k ELSE nx END AS b FROM g2 WHERE nx IS NOT NULL
        UNION ALL SELECT 'ring' || r, 2000 + k, oneway, 'n' || z, 'n' || f FROM g2 WHERE k = f AND f < z AND r % 3 = 2 UNION ALL SELECT 's' || k, 3000 + k, oneway, 'n' || k, 'x' || k FROM g2 WHERE r % 3 = 1 AND k % 7 = 3),
    en AS (SELECT way_id, 0 AS e, a AS node FROM pc UNION ALL SELECT way_id, 1, b FROM pc),
    jt AS (SELECT node FROM en WHERE node NOT IN (SELECT node_id FROM sg) GROUP BY node HAVING count(*) = 2 AND count(DISTINCT way_id) = 2),
    lk AS (SELECT x.way_id AS w, x.e, y.way_id AS w2, y.e AS e2, x.node FROM jt JOIN en x USING (node) JOIN en y USING (node) WHERE x.way_id <> y.way_id),
    cp(w, c) AS (SELECT way_id, way_id FROM pc UNION SELECT cp.w, lk.w2 FROM cp JOIN lk ON lk.w = cp.c),
    co AS (SELECT w, min(c) AS c FROM cp GROUP BY w),
    cut AS (SELECT min(node) AS node FROM lk JOIN co USING (w) GROUP BY c HAVING count(*) / 2 >= count(DISTINCT w)),
    l2 AS (SELECT * FROM lk WHERE node NOT IN (SELECT node FROM cut)),
    wk(s, sd, w, d, pos) AS (SELECT way_id, q.d, way_id, q.d, 0 FROM pc, (VALUES (0), (1)) AS q(d) WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.w = way_id AND l2.e = q.d)
        UNION ALL SELECT s, sd, w2, e2, pos + 1 FROM wk JOIN l2 ON l2.w = wk.w AND l2.e = 1 - wk.d),
    ch AS (SELECT s, sd, arg_min(w, (ord, w)) AS into_id, arg_min(d, (ord, w)) AS turn FROM wk JOIN pc ON way_id = w GROUP BY s, sd),
    pl AS (SELECT w, d, pos, into_id FROM wk JOIN ch USING (s, sd) WHERE turn = 0)"""


@query("merge_through_ways", f"""{_MERGED} SELECT into_id AS way_id, max(CASE WHEN pos = 0 THEN CASE d WHEN 0 THEN a ELSE b END END) || ',' || string_agg(CASE d WHEN 0 THEN b ELSE a END, ',' ORDER BY pos) AS nodes, max(CASE WHEN w = into_id THEN oneway END) AS oneway FROM pl JOIN pc ON way_id = w GROUP BY into_id""", recursive=True)
def merge_through_ways(s, d):
    nodes, ways, lamps = _pieces(s, d)
    return H.merge_through_ways(nodes, ways, None, lamps)[1].select("way_id", F.array_join("nodes", ",").alias("nodes"), F.try_element_at("tags", F.lit("oneway")).alias("oneway"))


@query("merged_phases", f"""{_MERGED}, ph AS (SELECT node_id, 0 AS k, unnest(['h' || r || '_' || (col - 1), 'h' || r || '_' || col]) AS w, unnest([0, 1]) AS pos FROM sg UNION ALL SELECT node_id, 1, unnest(['h' || (r + 1) || '_' || col, 'v' || col, 'h' || (r + 1) || '_' || (col + 1)]), unnest([0, 1, 2]) FROM sg),
    nm AS (SELECT node_id, k, coalesce(into_id, ph.w) AS w, min(ph.pos) AS pos FROM ph LEFT JOIN pl ON pl.w = ph.w GROUP BY ALL)
    SELECT node_id, k AS phase, string_agg(w, ',' ORDER BY pos) AS way_ids FROM nm GROUP BY node_id, k""", recursive=True)
def merged_phases(s, d):
    """The phases of all signals, under the names that ways have after the merge."""
    nodes, ways, lamps = _pieces(s, d)
    anew = H.remap_phases(lamps, H.merge_through_ways(nodes, ways, None, lamps)[2])
    return anew.select("node_id", F.posexplode("phases").alias("phase", "p")).select("node_id", "phase", F.array_join("p.wayIds", ",").alias("way_ids"))


_JOINED = """WITH c AS (SELECT CAST(substr(na, 2) AS BIGINT) AS a, CAST(substr(nb, 2) AS BIGINT) AS b, 2 * CAST(substr(na, 2) AS BIGINT) + (way_id LIKE 'v%')::INT AS ord, way_id || ':' || seq AS way_id, sqrt((ax / 8 - zx / 8)^2 + (ay / 8 - zy / 8)^2) AS len FROM seg),
    o AS (SELECT *, row_number() OVER (ORDER BY len, ord) AS i FROM c WHERE len <= 10),
    s(i, root, x0, x1, y0, y1, way_id, status) AS (SELECT 0::BIGINT, list(k ORDER BY k), list(x / 8 ORDER BY k), list(x / 8 ORDER BY k), list(y / 8 ORDER BY k), list(y / 8 ORDER BY k), NULL::VARCHAR, NULL::VARCHAR FROM g
        UNION ALL SELECT i, CASE WHEN joins THEN list_transform(root, lambda r: CASE WHEN r = h THEN l ELSE r END) ELSE root END, CASE WHEN joins THEN list_transform(x0, lambda v, j: CASE WHEN j = l + 1 THEN p0 ELSE v END) ELSE x0 END, CASE WHEN joins THEN list_transform(x1, lambda v, j: CASE WHEN j = l + 1 THEN p1 ELSE v END) ELSE x1 END,
            CASE WHEN joins THEN list_transform(y0, lambda v, j: CASE WHEN j = l + 1 THEN q0 ELSE v END) ELSE y0 END, CASE WHEN joins THEN list_transform(y1, lambda v, j: CASE WHEN j = l + 1 THEN q1 ELSE v END) ELSE y1 END, way_id, CASE WHEN l = h OR joins THEN 'dissolved' ELSE 'refused' END FROM
        (SELECT *, l <> h AND (p1 - p0)^2 + (q1 - q0)^2 <= 400 AS joins FROM (SELECT *, least(x0[l + 1], x0[h + 1]) AS p0, greatest(x1[l + 1], x1[h + 1]) AS p1, least(y0[l + 1], y0[h + 1]) AS q0, greatest(y1[l + 1], y1[h + 1]) AS q1 FROM
            (SELECT o.i, o.way_id, s.root, s.x0, s.x1, s.y0, s.y1, least(s.root[o.a + 1], s.root[o.b + 1]) AS l, greatest(s.root[o.a + 1], s.root[o.b + 1]) AS h FROM s JOIN o ON o.i = s.i + 1))))"""


def _scaled(s, d):
    """Every stretch between two nodes of the grid, an eighth of its size, as a connector between junctions."""
    from roadspark.operators.mapbuild import way_nodes

    nodes = X.nodes(s, d).select("node_id", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"))
    at = way_nodes(X.ways(s, d)).join(nodes, "node_id")
    w = Window.partitionBy("way_id").orderBy("seq")
    pairs = at.withColumns({"end_id": F.lead("node_id").over(w), "ex": F.lead("x").over(w), "ey": F.lead("y").over(w)}).where("end_id IS NOT NULL")
    order = "2 * CAST(substr(node_id, 2) AS BIGINT) + IF(way_id LIKE 'v%', 1, 0) AS ord"
    return pairs.selectExpr("concat_ws(':', way_id, seq) AS way_id", order, "node_id AS start_id", "end_id", "0 AS layer", "sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS len"), nodes


@query("join_groups", f"""{_JOINED}, f AS (SELECT unnest(root) AS r, unnest(range(0, len(root))) AS k FROM s WHERE i = (SELECT max(i) FROM s)), n AS (SELECT k, min('n' || k || '@0') OVER (PARTITION BY r) AS id FROM f),
    t AS (SELECT way_id, status FROM s WHERE i > 0 UNION ALL SELECT way_id, 'kept' FROM c WHERE len > 10) SELECT way_id, status, p.id AS start_group, q.id AS end_group FROM t JOIN c USING (way_id) JOIN n p ON p.k = a JOIN n q ON q.k = b""", recursive=True)
def join_groups(s, d):
    """Every connector's status, and the groups that its ends belong to in the end."""
    connectors, nodes = _scaled(s, d)
    told, groups = Q.join_groups(connectors, nodes)
    end = lambda c: groups.select(F.col("node_id").alias(f"{c}_id"), F.col("group_id").alias(f"{c}_group"))
    return told.join(end("start"), "start_id").join(end("end"), "end_id").select("way_id", "status", "start_group", "end_group")


_NODES = """WITH m AS (SELECT k, col, r, 'n' || k AS node_id, CASE WHEN col % 10 < 2 THEN 'g' || r || '_' || col // 10 END AS old, CASE WHEN col % 10 >= 1 AND col % 10 < 4 THEN 'b' || r || '_' || col // 10 WHEN col % 10 >= 6 THEN 'c' || r || '_' || col // 10 END AS sel FROM g),
    e AS (SELECT node_id AS a, 's' || sel AS b FROM m WHERE sel IS NOT NULL UNION SELECT node_id, 'g' || old FROM m WHERE old IN (SELECT old FROM m WHERE sel IS NOT NULL)),
    d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p(x, y) AS (SELECT a, a FROM d UNION SELECT p.x, d.b FROM p JOIN d ON d.a = p.y),
    c AS (SELECT x AS node_id, coalesce(min(substr(y, 2)) FILTER (y LIKE 'g%'), 'jg_' || min(substr(y, 2)) FILTER (y LIKE 's%')) AS group_id FROM p WHERE x LIKE 'n%' GROUP BY x),
    w2 AS (SELECT way_id || ':' || seq AS way_id, na, nb FROM seg), gone AS (SELECT way_id, a.group_id FROM w2 JOIN c a ON a.node_id = na JOIN c b ON b.node_id = nb WHERE a.group_id = b.group_id)"""


def _selections(s, d):
    """The stretches of the grid as ways; each ten columns of a row have an earlier group of two nodes, a selection of three that meets it, and one of four beside."""
    at = X.grid(s, d).selectExpr("concat('n', k) AS node_id", "IF(col % 10 < 2, map('join_group', concat('g', r, '_', col div 10)), CAST(map() AS map<string,string>)) AS tags", "CASE WHEN col % 10 BETWEEN 1 AND 3 THEN concat('b', r, '_', col div 10) WHEN col % 10 >= 6 THEN concat('c', r, '_', col div 10) END AS join_id")
    ways = _scaled(s, d)[0].selectExpr("way_id", "ord", "array(start_id, end_id) AS nodes")
    return at.select("node_id", "tags"), ways, at.where("join_id IS NOT NULL").select("join_id", "node_id")


@query("join_nodes", f"{_NODES} SELECT group_id, members, coalesce(dissolved, 0) AS dissolved FROM (SELECT group_id, count(*) AS members FROM c GROUP BY group_id) LEFT JOIN (SELECT group_id, count(*) AS dissolved FROM gone GROUP BY group_id) USING (group_id)", recursive=True)
def join_nodes(s, d):
    return Q.join_nodes(*_selections(s, d))[2]


@query("joined_nodes", f"{_NODES} SELECT node_id, coalesce(group_id, old) AS group_id FROM m LEFT JOIN c USING (node_id)", recursive=True)
def joined_nodes(s, d):
    return Q.join_nodes(*_selections(s, d))[0].select("node_id", F.try_element_at("tags", F.lit("join_group")).alias("group_id"))


@query("ungroup", "SELECT node_id, CASE WHEN r % 2 = 1 AND col % 10 < 2 THEN 'g' || r || '_' || col // 10 END AS group_id FROM nd")
def ungroup(s, d):
    """One node of each earlier group of every other row is picked."""
    nodes = _selections(s, d)[0]
    picked = X.grid(s, d).where("r % 2 = 0 AND (col % 10 = 0)").selectExpr("concat('n', k) AS node_id")
    return Q.ungroup(nodes, picked).select("node_id", F.try_element_at("tags", F.lit("join_group")).alias("group_id"))


def _through_json(s, d):
    """Two maps, the grid with straight and with curved ways, written as documents and read again."""
    ways = X.ways(s, d)
    signal = "struct(scheme, all_red_sec AS allRedSec, transform(phases, p -> struct(p.id AS id, CAST(NULL AS string) AS label, p.wayIds AS wayIds, p.greenSec AS greenSec, p.yellowSec AS yellowSec)) AS phases, paired, group_id AS groupId, 'inward' AS facing) AS signal"
    nodes = X.nodes(s, d).join(X.signals(s, d).selectExpr("node_id", signal), "node_id", "left").select("node_id", "x", "y", "tags", "signal")
    buildings, amenities = X.buildings(s, d).select("ord", "building_id", "tags", "polygon"), X.amenities(s, d).select("ord", "amenity_id", "x", "y", "tags", "building_id").withColumn("fleets", F.array().cast(f"array<{B.FLEET}>"))
    groups = X.signal_groups(s, d).selectExpr("CAST(substr(group_id, 2) AS INT) AS ord", "group_id", "member_ids", "turn_sec", "direction")
    both = lambda df: df.withColumn("map_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    curved = both(ways).withColumn("curve", F.when(F.col("map_id") == "b", "spline").otherwise("line"))
    meta = s.range(1).select(F.lit("a").alias("map_id"), F.from_json(F.lit('{"nextIdCounter": 5}'), B.META).alias("meta"))
    tables = B.MapTables(meta.unionByName(meta.withColumn("map_id", F.lit("b"))), both(nodes), curved, both(buildings), both(amenities), both(groups))
    path = f"{shared_dir(s)}/maps-{uuid.uuid4().hex}"
    B.write_map(tables, path)
    return B.read_map(s, path)


_MAPS = "(VALUES ('a', 'line'), ('b', 'spline')) AS q(map_id, curve)"


@query("map_json_nodes", f"SELECT map_id, node_id, x, y, CASE WHEN sg.node_id IS NULL THEN NULL WHEN paired THEN 'paired4way' ELSE 'phases' END AS scheme, CASE WHEN sg.paired THEN step ELSE green END AS sec, 'g' || sg.r AS group_id FROM nd LEFT JOIN sg USING (node_id), {_MAPS}")
def map_json_nodes(s, d):
    sec = F.coalesce(F.get("signal.paired.pairs", F.lit(1))["stepSec"], F.get("signal.phases", F.lit(1))["greenSec"])
    return _through_json(s, d).nodes.select("map_id", "node_id", "x", "y", "signal.scheme", sec.alias("sec"), F.col("signal.groupId").alias("group_id"))


@query("map_json_ways", f"SELECT map_id, way_id, row_number() OVER (PARTITION BY map_id ORDER BY ord) - 1 AS ord, highway, oneway, curve, (SELECT string_agg(node_id, ',' ORDER BY seq) FROM wn WHERE wn.way_id = w.way_id) AS nodes FROM w, {_MAPS}")
def map_json_ways(s, d):
    of = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return _through_json(s, d).ways.select("map_id", "way_id", F.col("ord").cast("long").alias("ord"), of("highway"), of("oneway"), "curve", F.array_join("nodes", ",").alias("nodes"))


@query("map_json_places", f"SELECT map_id, building_id AS id, building AS kind, cx - s / 2 AS x, cy - s / 2 AS y, NULL AS building_id FROM bl, {_MAPS} UNION ALL SELECT map_id, amenity_id, amenity, x, y, building_id FROM am, {_MAPS}")
def map_json_places(s, d):
    t = _through_json(s, d)
    of = lambda k: F.try_element_at("tags", F.lit(k)).alias("kind")
    corner = F.get("polygon", F.lit(0))
    buildings = t.buildings.select("map_id", F.col("building_id").alias("id"), of("building"), corner["x"].alias("x"), corner["y"].alias("y"), F.lit(None).cast("string").alias("building_id"))
    return buildings.unionByName(t.amenities.select("map_id", F.col("amenity_id").alias("id"), of("amenity"), "x", "y", "building_id"))


_BENT = """WITH p AS (SELECT way_id, seq, wn.x, wn.y, n, ord % 2 = 1 AS spline, k % 5 AS v FROM wn JOIN w USING (way_id, n) JOIN g ON node_id = 'n' || k),
    s AS (SELECT *, seq = 0 OR seq = n - 1 OR v = 1 OR (v <> 2 AND NOT spline) AS sharp FROM p),
    q AS (SELECT *, lag(x) OVER u AS x0, lag(y) OVER u AS y0, lead(x) OVER u AS x1, lead(y) OVER u AS y1, lead(x, 2) OVER u AS x2, lead(y, 2) OVER u AS y2, lead(sharp) OVER u AS next FROM s WINDOW u AS (PARTITION BY way_id ORDER BY seq)),
    h AS (SELECT *, sqrt((x - x0)^2 + (y - y0)^2) AS d0, sqrt((x1 - x)^2 + (y1 - y)^2) AS d1 FROM q),
    c AS (SELECT *, x + (x0 - x) * (least(d0, d1) * 0.4::DOUBLE / d0) AS ix, y + (y0 - y) * (least(d0, d1) * 0.4::DOUBLE / d0) AS iy, x + (x1 - x) * (least(d0, d1) * 0.4::DOUBLE / d1) AS ox, y + (y1 - y) * (least(d0, d1) * 0.4::DOUBLE / d1) AS oy,
        x + (x1 - CASE WHEN sharp THEN x ELSE x0 END) / 6 AS ax, y + (y1 - CASE WHEN sharp THEN y ELSE y0 END) / 6 AS ay, x1 - (CASE WHEN next THEN x1 ELSE x2 END - x) / 6 AS bx, y1 - (CASE WHEN next THEN y1 ELSE y2 END - y) / 6 AS by_ FROM h),
    f AS (SELECT way_id, seq, k, (1 - t)^3 * x + 3 * (1 - t)^2 * t * ax + 3 * (1 - t) * t^2 * bx + t^3 * x1 AS x, (1 - t)^3 * y + 3 * (1 - t)^2 * t * ay + 3 * (1 - t) * t^2 * by_ + t^3 * y1 AS y FROM c, LATERAL (SELECT k, k / 8.0::DOUBLE AS t FROM range(0, 9) AS z(k)) WHERE spline AND x1 IS NOT NULL AND (k > 0 OR seq = 0)
        UNION ALL SELECT way_id, seq, k, (1 - t)^2 * ix + 2 * (1 - t) * t * x + t^2 * ox, (1 - t)^2 * iy + 2 * (1 - t) * t * y + t^2 * oy FROM c, LATERAL (SELECT k, k / 8.0::DOUBLE AS t FROM range(0, 9) AS z(k)) WHERE NOT spline AND NOT sharp
        UNION ALL SELECT way_id, seq, 0, x, y FROM c WHERE NOT spline AND sharp)"""


@query("mixed_curve_points", f"{_BENT} SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY seq, k) - 1 AS seq, round(x, 3) AS x, round(y, 3) AS y FROM f")
def mixed_curve_points(s, d):
    """Every other way a spline; nodes of both vertex types on all of them."""
    kind = F.expr("CASE CAST(substr(node_id, 2) AS BIGINT) % 5 WHEN 1 THEN map('vertex_type', 'angle') WHEN 2 THEN map('vertex_type', 'curve') ELSE CAST(map() AS map<string,string>) END")
    ways = X.ways(s, d).withColumn("curve", F.when(F.col("ord") % 2 == 1, "spline").otherwise("line"))
    points = edits.mixed_curve_points(ways, X.nodes(s, d).withColumn("tags", kind))
    return points.select("way_id", F.col("seq").cast("long").alias("seq"), (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))
