"""Registered queries: each operator over tables derived from the given ones, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions.tags import cos, sin, tag
from roadspark.operators import graph as G
from roadspark.operators import mapbuild as M
from roadspark.operators import signals as L
from roadspark.operators import spatial as J
from roadspark.operators import telemetry as V
from roadspark.operators import trips as T
from roadspark.plans import fixtures as X
from roadspark.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    """Registers a query and, where SQL can express it, the SQL with the same rows."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle, recursive)
        return f

    return register


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


@query("map_bounds", "SELECT round(min(lat), 6) AS minlat, round(min(lon), 6) AS minlon, round(max(lat), 6) AS maxlat, round(max(lon), 6) AS maxlon, round((min(lat) + max(lat)) / 2, 6) AS origin_lat FROM nd")
def map_bounds(s, d):
    return M.map_bounds(X.nodes(s, d)).select(*(F.round(c, 6).alias(c) for c in ("minlat", "minlon", "maxlat", "maxlon", "origin_lat")))


@query("project_xy", "SELECT node_id, round(radians(lon - 77.6) * 6378137.0 * cos(radians(12.9)), 3) AS x, round(radians(lat - 12.9) * 6378137.0, 3) AS y FROM nd")
def project_xy(s, d):
    return M.project_xy(X.nodes(s, d).drop("x", "y"), 12.9, 77.6).select("node_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("project_inverse", "SELECT node_id, round(12.9 + degrees(y / 6378137.0), 8) AS lat, round(77.6 + degrees(x / (6378137.0 * cos(radians(12.9)))), 8) AS lon FROM nd")
def project_inverse(s, d):
    return M.project_inverse(X.nodes(s, d).drop("lat", "lon"), 12.9, 77.6).select("node_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("routable_ways", "SELECT way_id, n FROM rw")
def routable_ways(s, d):
    return M.routable_ways(X.ways(s, d), X.nodes(s, d)).select("way_id", F.size("nodes").cast("long").alias("n"))


@query("way_speed", "SELECT way_id, kmh AS speed_kmh, round(kmh / 3.6, 4) AS speed_mps FROM ws")
def way_speed(s, d):
    return M.way_speed(X.ways(s, d)).select("way_id", "speed_kmh", *r4("speed_mps"))


@query("way_direction", "SELECT way_id, fwd AS forward, bwd AS backward FROM ws")
def way_direction(s, d):
    return M.way_direction(X.ways(s, d))


@query("way_layer", "SELECT way_id, CASE WHEN bridge = 'yes' THEN 1 ELSE 0 END AS layer FROM w")
def way_layer(s, d):
    return M.way_layer(X.ways(s, d))


@query("lane_policy", "SELECT way_id, CASE WHEN highway = 'primary' THEN '3' WHEN highway = 'secondary' THEN CASE WHEN oneway = 'yes' THEN '2' ELSE '4' END WHEN highway = 'tertiary' AND coalesce(oneway, '') <> 'yes' THEN '2' WHEN highway = 'residential' THEN coalesce(lanes, '2') ELSE lanes END AS lanes FROM w")
def lane_policy(s, d):
    return M.lane_policy(X.ways(s, d)).select("way_id", tag("lanes").alias("lanes"))


@query("road_defaults", """SELECT way_id, coalesce(maxspeed, '60') AS maxspeed, '20' AS avg_min_speed, '60' AS avg_max_speed, coalesce(lanes, '1') AS lanes, '3.2' AS lane_width,
    coalesce(divider, CASE WHEN oneway = 'yes' OR coalesce(lanes, '1')::INT < 2 THEN 'no' ELSE 'yes' END) AS divider FROM w""")
def road_defaults(s, d):
    return M.road_defaults(X.ways(s, d)).select("way_id", *(tag(k).alias(k) for k in ("maxspeed", "avg_min_speed", "avg_max_speed", "lanes", "lane_width", "divider")))


@query("way_geometry", "SELECT way_id, round(sum(d), 4) AS length_m, round(coalesce(max(lanes)::DOUBLE, 2) * 3.2, 4) AS width_m FROM seg JOIN w USING (way_id) GROUP BY way_id")
def way_geometry(s, d):
    return M.way_geometry(X.ways(s, d), X.nodes(s, d)).select("way_id", *r4("length_m", "width_m"))


@query("node_touch_count", "SELECT node_id, count(DISTINCT way_id) AS touches FROM wn JOIN veh USING (way_id) GROUP BY node_id")
def node_touch_count(s, d):
    return M.node_touch_count(X.ways(s, d))


@query("split_ways", """SELECT CASE WHEN p = 0 THEN way_id ELSE way_id || '_s' || p END AS way_id, string_agg(node_id, ',' ORDER BY seq) AS nodes FROM
    (SELECT way_id, seq, node_id, unnest(CASE WHEN cut = 1 THEN [piece, piece + 1] ELSE [piece] END)::BIGINT AS p FROM piece) GROUP BY way_id, p HAVING count(*) >= 2
    UNION ALL SELECT way_id, string_agg(node_id, ',' ORDER BY seq) FROM wn WHERE way_id NOT IN (SELECT way_id FROM veh) GROUP BY way_id""")
def split_ways(s, d):
    return M.split_ways(X.ways(s, d)).select("way_id", F.array_join("nodes", ",").alias("nodes"))


@query("junction_endpoints", """SELECT node_id, CASE WHEN bridge = 'yes' THEN 1 ELSE 0 END AS layer, count(*) AS ends, count(*) >= 2 AS is_junction FROM
    (SELECT way_id, p.piece AS p, min(seq) AS a, max(seq) AS b FROM (SELECT way_id, seq, unnest(CASE WHEN cut = 1 THEN [piece, piece + 1] ELSE [piece] END) AS piece FROM piece) p GROUP BY way_id, p.piece HAVING count(*) >= 2) e
    JOIN wn ON wn.way_id = e.way_id AND wn.seq IN (e.a, e.b) JOIN veh ON veh.way_id = e.way_id GROUP BY ALL""")
def junction_endpoints(s, d):
    return M.junction_endpoints(M.split_ways(X.ways(s, d)))


@query("trim_ways", """WITH e AS (SELECT way_id, seq, node_id, CASE WHEN bridge = 'yes' THEN 1 ELSE 0 END AS layer, seq > 0 AS last FROM wn JOIN veh v USING (way_id) WHERE seq = 0 OR seq = wn.n - 1),
    j AS (SELECT node_id, layer FROM e GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT way_id, count(*) * 2.5 AS cuts FROM e JOIN j USING (node_id, layer) GROUP BY way_id),
    t AS (SELECT way_id, sum(d) AS total FROM seg WHERE way_id IN (SELECT way_id FROM veh) GROUP BY way_id)
    SELECT way_id, round(CASE WHEN total <= coalesce(cuts, 0) THEN total ELSE total - coalesce(cuts, 0) END, 4) AS trimmed_len FROM t LEFT JOIN c USING (way_id)""")
def trim_ways(s, d):
    """Length along the trimmed points, which has to be the way's own less its cuts."""
    from pyspark.sql import Window

    p = M.trim_ways(X.ways(s, d), X.nodes(s, d))
    w = Window.partitionBy("way_id").orderBy("seq")
    step = p.withColumn("d", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    return step.groupBy("way_id").agg(F.round(F.sum("d"), 4).alias("trimmed_len"))


@query("prune_nodes", "SELECT node_id, round_even(x, 2) AS x, round_even(y, 2) AS y FROM nd WHERE node_id IN (SELECT node_id FROM wn)")
def prune_nodes(s, d):
    return M.prune_nodes(X.nodes(s, d), X.ways(s, d))[0].select("node_id", "x", "y")


@query("polygon_measures", "SELECT building_id, s * s AS area_m2, round(cx, 4) AS cx, round(cy, 4) AS cy, cx - s / 2 AS min_x, cy - s / 2 AS min_y, cx + s / 2 AS max_x, cy + s / 2 AS max_y FROM bl")
def polygon_measures(s, d):
    return M.polygon_measures(X.buildings(s, d)).select("building_id", "area_m2", *r4("cx", "cy"), "min_x", "min_y", "max_x", "max_y")


@query("node_index", "SELECT node_id, (SELECT count(DISTINCT way_id) FROM wn WHERE wn.node_id = nd.node_id) AS degree, 'g' || (k % 97) AS group_id, 'n' || (SELECT min('' || o.k) FROM nd o WHERE o.k % 97 = nd.k % 97) AS primary_node_id, (SELECT count(*) FROM nd o WHERE o.k % 97 = nd.k % 97) AS group_size FROM nd")
def node_index(s, d):
    key = F.substring("node_id", 2, 20).cast("long") % 97
    nodes = X.nodes(s, d).withColumn("tags", F.create_map(F.lit("join_group"), F.concat(F.lit("g"), key)))
    return M.node_index(nodes, X.ways(s, d)).select("node_id", "degree", "group_id", "primary_node_id", "group_size")


@query("orphan_cleanup", "SELECT node_id FROM nd WHERE node_id IN (SELECT node_id FROM wn JOIN rw USING (way_id))")
def orphan_cleanup(s, d):
    ways = M.routable_ways(X.ways(s, d), X.nodes(s, d))
    return M.orphan_cleanup(X.nodes(s, d), ways)[0].select("node_id")


@query("dangling_refs", "SELECT way_id, seq, node_id FROM wn WHERE CAST(substr(node_id, 2) AS BIGINT) % 13 = 5")
def dangling_refs(s, d):
    known = X.nodes(s, d).where(F.substring("node_id", 2, 20).cast("long") % 13 != 5)
    return M.dangling_refs(X.ways(s, d), known).select("way_id", F.col("seq").cast("long").alias("seq"), "node_id")


@query("road_view", "SELECT way_id, count(*) AS n FROM wn JOIN w USING (way_id) WHERE highway <> 'footway' AND CAST(substr(node_id, 2) AS BIGINT) % 13 <> 5 GROUP BY way_id HAVING count(*) >= 2")
def road_view(s, d):
    known = X.nodes(s, d).where(F.substring("node_id", 2, 20).cast("long") % 13 != 5)
    return M.road_view(known, X.ways(s, d))[0].select("way_id", F.size("nodes").cast("long").alias("n"))


@query("add_only_merge", "SELECT building_id FROM bl")
def add_only_merge(s, d):
    b = X.buildings(s, d).select("building_id", "ord")
    return M.add_only_merge(b.where("ord % 3 = 0"), b.where("ord % 2 = 0 or ord % 3 <> 0"), "building_id")[0].select("building_id")


@query("bulk_tags", "SELECT way_id, CASE WHEN highway = 'residential' THEN '30' ELSE maxspeed END AS maxspeed FROM w")
def bulk_tags(s, d):
    ways = X.ways(s, d)
    return M.bulk_tags(ways, ways.where(tag("highway") == "residential"), "way_id", "maxspeed", "30").select("way_id", tag("maxspeed").alias("maxspeed"))


def _points(s, d):
    return X.incidents(s, d).select(F.col("incident_id").alias("id"), "x", "y")


@query("nearest_node", "SELECT i.incident_id AS id, b.node_id, round(sqrt(b.d2), 4) AS dist_m FROM inc i, LATERAL (SELECT node_id, (nd.x - i.x)^2 + (nd.y - i.y)^2 AS d2 FROM nd ORDER BY d2, node_id LIMIT 1) b")
def nearest_node(s, d):
    return J.nearest_node(_points(s, d), X.nodes(s, d)).select("id", "node_id", *r4("dist_m"))


@query("nearest_way", """WITH c AS (SELECT i.incident_id AS id, s.way_id, i.x, i.y, s.*, greatest(0, least(1, ((i.x - ax) * (zx - ax) + (i.y - ay) * (zy - ay)) / nullif((zx - ax)^2 + (zy - ay)^2, 0))) AS t FROM inc i, seg s),
    e AS (SELECT id, way_id, min(sqrt((x - ax - t * (zx - ax))^2 + (y - ay - t * (zy - ay))^2)) AS d FROM c GROUP BY id, way_id)
    SELECT id, arg_min(way_id, (round(d, 6), way_id)) AS way_id, round(arg_min(d, (round(d, 6), way_id)), 4) AS dist_m FROM e WHERE d <= 25 GROUP BY id""")
def nearest_way(s, d):
    return J.nearest_way(_points(s, d), X.ways(s, d), X.nodes(s, d), 25.0).select("id", "way_id", *r4("dist_m"))


@query("nearest_amenity", "SELECT i.incident_id AS id, arg_min(amenity_id, ((a.x - i.x)^2 + (a.y - i.y)^2, amenity_id)) AS amenity_id, round(min(sqrt((a.x - i.x)^2 + (a.y - i.y)^2)), 4) AS dist_m FROM inc i, am a WHERE sqrt((a.x - i.x)^2 + (a.y - i.y)^2) <= 120 GROUP BY 1")
def nearest_amenity(s, d):
    return J.nearest_amenity(_points(s, d), X.amenities(s, d), 120.0).select("id", "amenity_id", *r4("dist_m"))


@query("point_in_building", "SELECT i.incident_id AS id, arg_min(building_id, ord) AS building_id FROM inc i, bl b WHERE i.x + 0.25 > cx - s / 2 AND i.x + 0.25 < cx + s / 2 AND i.y + 0.25 > cy - s / 2 AND i.y + 0.25 < cy + s / 2 GROUP BY 1")
def point_in_building(s, d):
    return J.point_in_building(_points(s, d).select("id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y")), X.buildings(s, d))


@query("bbox_select", """SELECT 'node' AS kind, node_id AS id FROM nd WHERE x BETWEEN 100 AND 900 AND y BETWEEN 50 AND 700 UNION ALL SELECT DISTINCT 'way', way_id FROM wn WHERE x BETWEEN 100 AND 900 AND y BETWEEN 50 AND 700
    UNION ALL SELECT 'building', building_id FROM bl WHERE (cx - s / 2 BETWEEN 100 AND 900 OR cx + s / 2 BETWEEN 100 AND 900) AND (cy - s / 2 BETWEEN 50 AND 700 OR cy + s / 2 BETWEEN 50 AND 700)
    UNION ALL SELECT 'amenity', amenity_id FROM am WHERE x BETWEEN 100 AND 900 AND y BETWEEN 50 AND 700""")
def bbox_select(s, d):
    return J.bbox_select(X.nodes(s, d), X.ways(s, d), X.buildings(s, d), X.amenities(s, d), 100, 50, 900, 700)


@query("segment_crossings", """WITH p AS (SELECT a.way_id AS way_a, a.seq AS seq_a, b.way_id AS way_b, b.seq AS seq_b, a.ax, a.ay, a.zx - a.ax AS rx, a.zy - a.ay AS ry, b.zx - b.ax AS sx, b.zy - b.ay AS sy, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM seg a JOIN seg b ON a.way_id < b.way_id)
    SELECT way_a, seq_a, way_b, seq_b, round(ax + (qx * sy - qy * sx) / (rx * sy - ry * sx) * rx, 4) AS x, round(ay + (qx * sy - qy * sx) / (rx * sy - ry * sx) * ry, 4) AS y FROM p
    WHERE rx * sy - ry * sx <> 0 AND (qx * sy - qy * sx) / (rx * sy - ry * sx) BETWEEN 0 AND 1 AND (qx * ry - qy * rx) / (rx * sy - ry * sx) BETWEEN 0 AND 1""")
def segment_crossings(s, d):
    return J.segment_crossings(X.ways(s, d), X.nodes(s, d)).select("way_a", F.col("seq_a").cast("long").alias("seq_a"), "way_b", F.col("seq_b").cast("long").alias("seq_b"), *r4("x", "y"))


_TIERS = "SELECT DISTINCT node_id, x, y, CASE highway WHEN 'tertiary' THEN 'secondary' ELSE highway END AS tier FROM wn JOIN w USING (way_id) WHERE highway IN ('trunk', 'primary', 'secondary', 'tertiary')"
_NEAR = f"""maj AS ({_TIERS}), nr AS (SELECT b.building_id, b.cx AS px, b.cy AS py, m.tier, sqrt((m.x - b.cx)^2 + (m.y - b.cy)^2) AS d, greatest(abs(floor(m.x / 40) - floor(b.cx / 40)), abs(floor(m.y / 40) - floor(b.cy / 40))) AS ring FROM bl b, maj m WHERE (m.x - b.cx)^2 + (m.y - b.cy)^2 < 22500 AND abs(m.x - b.cx) < 150),
    fr AS (SELECT building_id, greatest(1, min(ring)) AS k FROM nr GROUP BY 1), nm AS (SELECT nr.building_id, arg_min(tier, (d, tier)) AS tier, min(d) AS d FROM nr JOIN fr ON nr.building_id = fr.building_id AND ring <= k GROUP BY 1)"""


@query("nearest_major_road", f"WITH {_NEAR} SELECT building_id AS id, tier, round(d, 4) AS dist_m FROM nm")
def nearest_major_road(s, d):
    points = M.polygon_measures(X.buildings(s, d)).select(F.col("building_id").alias("id"), F.round("cx", 6).alias("x"), F.round("cy", 6).alias("y"))
    return J.nearest_major_road(points, X.nodes(s, d), X.ways(s, d)).select("id", "tier", *r4("dist_m"))


@query("amenity_by_building", "SELECT building_id, arg_max(amenity_id, ord) AS amenity_id, arg_max(amenity, ord) AS amenity FROM am WHERE building_id IS NOT NULL GROUP BY 1")
def amenity_by_building(s, d):
    return J.amenity_by_building(X.amenities(s, d))


@query("retag_buildings", f"""WITH {_NEAR}, ab AS (SELECT building_id, arg_max(amenity, ord) AS amenity FROM am WHERE building_id IS NOT NULL GROUP BY 1)
    SELECT b.building_id, CASE WHEN amenity IS NOT NULL THEN CASE amenity WHEN 'hospital' THEN 'hospital' WHEN 'police' THEN 'civic' WHEN 'clinic' THEN 'clinic' WHEN 'cafe' THEN 'retail' ELSE 'school' END
      WHEN brand = 'Brand#1' THEN 'retail' WHEN brand = 'Brand#2' THEN 'office' WHEN brand = 'Brand#3' THEN 'hotel' WHEN brand = 'Brand#4' THEN 'commercial'
      WHEN tier IS NULL THEN 'residential' WHEN d > 60 THEN 'apartments' WHEN tier = 'trunk' AND s * s >= 250 THEN 'industrial' ELSE 'commercial' END AS building
    FROM bl b LEFT JOIN ab USING (building_id) LEFT JOIN nm USING (building_id) WHERE building = 'yes'""")
def retag_buildings(s, d):
    return J.retag_buildings(X.buildings(s, d), X.amenities(s, d), X.nodes(s, d), X.ways(s, d))


@query("routing_edges", "SELECT src, dst, round(weight, 4) AS weight_sec, 'chain' AS kind, way_id FROM edge")
def routing_edges(s, d):
    return G.routing_edges(X.nodes(s, d), X.ways(s, d)).select("src", "dst", *r4("weight_sec"), "kind", "way_id")


@query("chain_edges", """SELECT way_id || ':' || seq || ':' || CASE WHEN f THEN 'f' ELSE 'b' END AS edge_id, replace(replace(src, '#fwd', ''), '#bwd', '') AS src, replace(replace(dst, '#fwd', ''), '#bwd', '') AS dst, round(d, 4) AS length_m, round(mps, 4) AS speed_mps, coalesce(lanes, '1')::INT AS lanes,
    CASE WHEN two THEN greatest(1, coalesce(lanes, '1')::INT // 2) ELSE coalesce(lanes, '1')::INT END AS lanes_per_direction, round(CASE WHEN two THEN coalesce(lanes, '1')::INT * 3.2 / 4 ELSE 0 END, 4) AS offset_m,
    CASE highway WHEN 'trunk' THEN 5 WHEN 'primary' THEN 4 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 2 ELSE 1 END AS rank FROM edge""")
def chain_edges(s, d):
    return G.chain_edges(X.nodes(s, d), X.ways(s, d)).select("edge_id", "src", "dst", *r4("length_m", "speed_mps"), "lanes", "lanes_per_direction", *r4("offset_m"), "rank")


@query("way_terminals", """SELECT na AS node_id, way_id, round((zx - ax) / d, 4) AS out_dx, round((zy - ay) / d, 4) AS out_dy FROM seg JOIN rw USING (way_id) WHERE seq = 0
    UNION ALL SELECT nb, way_id, round((ax - zx) / d, 4), round((ay - zy) / d, 4) FROM seg JOIN rw USING (way_id) WHERE seq = seg.n - 2""")
def way_terminals(s, d):
    return G.way_terminals(X.nodes(s, d), X.ways(s, d)).select("node_id", "way_id", *r4("out_dx", "out_dy"))


@query("classify_movement", """WITH t AS (SELECT event_id, cos(heading * 0.0175) AS ax, sin(heading * 0.0175) AS ay, cos(speed_kmh * 0.1) AS dx, sin(speed_kmh * 0.1) AS dy FROM fx WHERE heading IS NOT NULL)
    SELECT event_id, CASE WHEN ax * dx + ay * dy < -0.7 THEN 'uturn' WHEN atan2(ax * dy - ay * dx, ax * dx + ay * dy) < -0.1 THEN 'right' ELSE 'through' END AS movement FROM t""")
def classify_movement(s, d):
    f = X.fixes(s, d).where("heading_deg is not null")
    return G.classify_movement(f.select("event_id", cos(F.col("heading_deg") * 0.0175).alias("arr_x"), sin(F.col("heading_deg") * 0.0175).alias("arr_y"), cos(F.col("speed_kmh") * 0.1).alias("dep_x"), sin(F.col("speed_kmh") * 0.1).alias("dep_y"))).select("event_id", "movement")


def _grouped(s, d):
    """Nodes in junctions of two by two, and signals."""
    k = F.substring("node_id", 2, 20).cast("long")
    group = F.concat(F.lit("j"), F.floor(k / 80), F.lit("_"), F.floor(k % 40 / 2))
    return X.nodes(s, d).withColumn("tags", F.create_map(F.lit("join_group"), group)), X.signals(s, d)


_GROUPED = "jm AS (SELECT nd.node_id, nd.x, nd.y, 'j' || (nd.k // 80) || '_' || (nd.k % 40 // 2) AS gid FROM nd WHERE node_id IN (SELECT node_id FROM wn JOIN rw USING (way_id)))"


@query("signal_wait", "WITH a AS (SELECT 'j' || (k // 80) || '_' || (k % 40 // 2) AS group_id, node_id, CASE WHEN paired THEN 2.0 ELSE 2.0 + 2 * (green + 3) END AS c FROM sg) SELECT group_id, arg_min(c, node_id) / 2 AS wait_sec FROM a GROUP BY 1")
def signal_wait(s, d):
    return G.signal_wait(*_grouped(s, d))


@query("junctions", f"""WITH {_GROUPED}, sp AS (SELECT gid, avg(kmh / 3.6) AS v FROM (SELECT DISTINCT jm.gid, wn.way_id, rw.kmh FROM jm JOIN wn USING (node_id) JOIN rw ON rw.way_id = wn.way_id WHERE wn.seq = 0 OR wn.seq = wn.n - 1) GROUP BY 1)
    SELECT jm.gid AS junction_id, coalesce(min(jm.node_id) FILTER (sg.node_id IS NOT NULL), min(jm.node_id)) AS primary_node_id, string_agg(jm.node_id, ',' ORDER BY jm.node_id) AS members, round(max(sp.v), 4) AS approach_speed_mps, bool_or(sg.node_id IS NOT NULL) AS signalized
    FROM jm LEFT JOIN sg USING (node_id) LEFT JOIN sp ON sp.gid = jm.gid GROUP BY jm.gid""")
def junctions(s, d):
    n, sig = _grouped(s, d)
    return G.junctions(n, X.ways(s, d), sig).select("junction_id", "primary_node_id", F.array_join("members", ",").alias("members"), *r4("approach_speed_mps"), "signalized")


@query("junction_edges", f"""WITH {_GROUPED}, ends AS (SELECT wn.node_id, wn.way_id, rw.ord, CASE WHEN wn.seq = 0 THEN (s.zx - s.ax) / s.d ELSE (s.ax - s.zx) / s.d END AS ox, CASE WHEN wn.seq = 0 THEN (s.zy - s.ay) / s.d ELSE (s.ay - s.zy) / s.d END AS oy FROM wn JOIN rw ON rw.way_id = wn.way_id JOIN seg s ON s.way_id = wn.way_id AND s.seq = CASE WHEN wn.seq = 0 THEN 0 ELSE wn.n - 2 END WHERE wn.seq = 0 OR wn.seq = wn.n - 1),
    f AS (SELECT DISTINCT ON (node_id) * FROM ends ORDER BY node_id, ord, way_id),
    q AS (SELECT a.gid, a.node_id AS src, b.node_id AS dst, fa.way_id AS from_way, fb.way_id AS to_way, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS d, -coalesce(fa.ox, 0) AS ax, -coalesce(fa.oy, 0) AS ay, coalesce(fb.ox, 0) AS dx, coalesce(fb.oy, 0) AS dy FROM jm a JOIN jm b ON a.gid = b.gid AND a.node_id <> b.node_id LEFT JOIN f fa ON fa.node_id = a.node_id LEFT JOIN f fb ON fb.node_id = b.node_id)
    SELECT src, dst, from_way, to_way, round(d, 4) AS length_m, CASE WHEN ax * dx + ay * dy < -0.7 THEN 'uturn' WHEN atan2(ax * dy - ay * dx, ax * dx + ay * dy) < -0.1 THEN 'right' ELSE 'through' END AS movement FROM q""")
def junction_edges(s, d):
    n, sig = _grouped(s, d)
    return G.junction_edges(n, X.ways(s, d), sig).select("src", "dst", "from_way", "to_way", *r4("length_m"), "movement")


@query("weak_components", """WITH e AS (SELECT DISTINCT na AS a, nb AS b FROM seg JOIN rw USING (way_id) WHERE (seq + length(way_id)) % 5 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
    c AS (SELECT a AS node_id, a AS component FROM u UNION SELECT u.b, c.component FROM c JOIN u ON u.a = c.node_id)
    SELECT node_id, min(component) AS component FROM c GROUP BY 1""", recursive=True)
def weak_components(s, d):
    e = J.segments(M.routable_ways(X.ways(s, d), X.nodes(s, d)), X.nodes(s, d))
    ids = M.way_nodes(X.ways(s, d))
    a, b = ids.withColumnRenamed("node_id", "src"), ids.select("way_id", (F.col("seq") - 1).alias("seq"), F.col("node_id").alias("dst"))
    edges = e.where((F.col("seq") + F.length("way_id")) % 5 != 0).join(a, ["way_id", "seq"]).join(b, ["way_id", "seq"]).select("src", "dst")
    return G.weak_components(edges)


@query("lamp_state_phases", """WITH q AS (SELECT node_id, u.way_id, u.p, u.t, green, u.t % (2 * (green + 5)) AS l FROM sg, LATERAL (SELECT w AS way_id, p, t::DOUBLE AS t FROM (VALUES ('h' || r, 0), ('v' || col, 1), ('none', 2)) AS v(w, p), range(0, 200, 7) AS z(t)) u WHERE NOT paired)
    SELECT node_id, way_id, t, CASE WHEN p = 2 THEN 'red' WHEN l - p * (green + 5) BETWEEN 0 AND green - 0.001 THEN 'green' WHEN l - p * (green + 5) BETWEEN green AND green + 2.999 THEN 'yellow' ELSE 'red' END AS color,
      CASE WHEN p = 2 THEN 2 * (green + 5) WHEN l - p * (green + 5) BETWEEN 0 AND green - 0.001 THEN green - (l - p * (green + 5)) WHEN l - p * (green + 5) BETWEEN green AND green + 2.999 THEN green + 3 - (l - p * (green + 5))
           WHEN p * (green + 5) > l THEN p * (green + 5) - l ELSE p * (green + 5) - l + 2 * (green + 5) END AS remaining_sec FROM q""")
def lamp_state_phases(s, d):
    sig = X.signals(s, d)
    ways = F.explode(F.array(F.concat(F.lit("h"), "r"), F.concat(F.lit("v"), "col"), F.lit("none")))
    asks = sig.where("scheme = 'phases'").select("node_id", ways.alias("way_id")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(199), F.lit(7)).cast("array<double>")))
    return L.lamp_state_phases(sig, asks)


@query("cycle_length", "SELECT node_id, CASE WHEN paired THEN 8 * step + 4 ELSE 2 * (green + 3 + 2) END AS cycle_sec FROM sg")
def cycle_length(s, d):
    return L.cycle_length(X.signals(s, d))


@query("phase_segments", """SELECT node_id, p * (green + 5) + a AS start, p * (green + 5) + b AS "end", c AS color, CASE c WHEN 'red' THEN -1 ELSE p END AS phase FROM sg, LATERAL (VALUES (0), (1)) AS v(p), LATERAL (VALUES (0.0, green, 'green'), (green, green + 3, 'yellow'), (green + 3, green + 5, 'red')) AS z(a, b, c) WHERE NOT paired""")
def phase_segments(s, d):
    return L.phase_segments(X.signals(s, d)).drop("way_ids")


@query("lamp_state_paired", """WITH q AS (SELECT node_id, way_id, isa, pi, m, t, step, (t % (8 * step + 4)) AS tm FROM sg, LATERAL (VALUES ('h' || r, true, 0), ('h' || r || 'w', false, 0), ('v' || col, true, 1), ('v' || col || 's', false, 1)) AS v(way_id, isa, pi), (VALUES ('through'), ('right')) AS z(m), range(0, 150, 11) AS y(t) WHERE paired),
    a AS (SELECT *, tm - pi * (4 * step + 2) AS l, CASE WHEN m = 'right' THEN CASE WHEN isa THEN step ELSE 3 * step END ELSE CASE WHEN isa THEN 2 * step ELSE 0 END END AS rs, CASE WHEN m = 'right' THEN 3 * step ELSE step END AS rl FROM q),
    b AS (SELECT *, l >= 0 AND l < 4 * step AS act, (l - rs + 8 * step) % (4 * step) AS o FROM a)
    SELECT node_id, way_id, m AS movement, t::DOUBLE AS t, CASE WHEN NOT act OR o < rl THEN 'red' WHEN 4 * step - o <= 3 THEN 'yellow' ELSE 'green' END AS color,
      CASE WHEN NOT act THEN CASE WHEN l < 0 THEN -l ELSE -l + 8 * step + 4 END WHEN o < rl THEN rl - o WHEN 4 * step - o <= 3 THEN 4 * step - o ELSE 4 * step - o - 3 END AS remaining_sec FROM b""")
def lamp_state_paired(s, d):
    sig = X.signals(s, d)
    ways = F.explode(F.array(F.concat(F.lit("h"), "r"), F.concat(F.lit("h"), "r", F.lit("w")), F.concat(F.lit("v"), "col"), F.concat(F.lit("v"), "col", F.lit("s"))))
    asks = sig.where("scheme = 'paired4way'").select("node_id", ways.alias("way_id")).withColumn("movement", F.explode(F.array(F.lit("through"), F.lit("right")))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(149), F.lit(11)).cast("array<double>")))
    return L.lamp_state_paired(sig, asks)


@query("group_turn", """WITH m AS (SELECT 'g' || r AS gid, node_id, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY r) AS n FROM sg), q AS (SELECT m.*, t::DOUBLE AS t, t % (30 * n) AS l FROM m, range(0, 1000, 37) AS z(t) WHERE n >= 2)
    SELECT q.gid AS group_id, q.node_id, q.t, a.node_id AS active_node_id, (q.l % 30)::DOUBLE AS local_clock, CASE WHEN q.i = q.l // 30 THEN 0 ELSE ((q.i - q.l // 30 + q.n) % q.n) * 30 - q.l % 30 END::DOUBLE AS wait_sec FROM q JOIN m a ON a.gid = q.gid AND a.i = q.l // 30""")
def group_turn(s, d):
    asks = X.signals(s, d).select("group_id", "node_id").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(999), F.lit(37)).cast("array<double>")))
    return L.group_turn(X.signal_groups(s, d), asks)


@query("lamp_timeline", """WITH q AS (SELECT node_id, w AS way_id, green, p, (t % (2 * (green + 5)) - p * (green + 5)) AS o FROM sg, LATERAL (VALUES ('h' || r, 0), ('v' || col, 1)) AS v(w, p), range(5, 1005) AS z(t) WHERE NOT paired)
    SELECT node_id, way_id, sum((o >= 0 AND o < green)::INT)::DOUBLE AS green_sec, sum((o >= green AND o < green + 3)::INT)::DOUBLE AS yellow_sec, sum((o < 0 OR o >= green + 3)::INT)::DOUBLE AS red_sec FROM q GROUP BY ALL""")
def lamp_timeline(s, d):
    return L.lamp_timeline(X.signals(s, d), 5, 1005)


@query("approach_weights", "SELECT t // 10 AS t, edge % 7 AS junction_id, edge AS way_id, round(sum((dist - 20) * CASE vehicle_type WHEN 'bus' THEN 10 WHEN 'truck' THEN 0.1 WHEN 'motorcycle' THEN 0.5 ELSE 1 END), 4) AS weight FROM st WHERE dist > 20 GROUP BY ALL")
def approach_weights(s, d):
    q = X.states(s, d).selectExpr("t div 10 AS t", "edge % 7 AS junction_id", "edge AS way_id", "vehicle_type AS type", "dist - 20 AS waited_sec")
    return L.approach_weights(q).select("t", "junction_id", "way_id", *r4("weight"))



@query("preempt_episodes", """WITH q AS (SELECT user_id % 40 AS junction_id, event_id % 300 AS t, event_type AS way_id FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER w < 5 THEN 0 ELSE 1 END AS n FROM q WINDOW w AS (PARTITION BY junction_id ORDER BY t, way_id)), e AS (SELECT *, sum(n) OVER (PARTITION BY junction_id ORDER BY t, way_id ROWS UNBOUNDED PRECEDING) AS ep FROM f)
    SELECT junction_id, min(t) AS start, min(t) + 5.0::DOUBLE AS clear_until, max(t) + 5.0::DOUBLE AS hold_until, max(way_id) FILTER (t = mt) AS way_id FROM (SELECT *, max(t) OVER (PARTITION BY junction_id, ep) AS mt FROM e) GROUP BY junction_id, ep""")
def preempt_episodes(s, d):
    q = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 40 AS junction_id", "event_id % 300 AS t", "event_type AS way_id")
    return L.preempt_episodes(q).drop("episode")


@query("parse_gps", "SELECT vehicle_id, vehicle_type, round(12.9 + y * 1e-5, 6) AS lat, ((heading::INT % 360) + 360) % 360 AS heading_deg, t FROM fx WHERE event_id % 101 <> 0")
def parse_gps(s, d):
    f = X.fixes(s, d)
    raw = f.select(F.to_json(F.struct(F.col("vehicle_id").alias("vehicleId"), F.col("vehicle_type").alias("vehicleType"), "lat", "lon", F.col("heading_deg").alias("headingDeg"), F.col("speed_kmh").alias("speedKmh"), "ts")).alias("value"))
    return V.parse_gps(raw)[0].select("vehicle_id", "vehicle_type", F.round("lat", 6).alias("lat"), F.col("heading_deg").cast("int").alias("heading_deg"), (F.unix_seconds("ts") - 1704067200).alias("t"))


@query("latest_wins_upsert", "SELECT DISTINCT ON (vehicle_id) vehicle_id, t, x, y FROM fx ORDER BY vehicle_id, t DESC")
def latest_wins_upsert(s, d):
    f = X.fixes(s, d).select("vehicle_id", "t", "x", "y")
    return V.latest_wins_upsert(f.where("t % 2 = 0"), f.where("t % 2 = 1"), "vehicle_id", "t")


@query("live_sessions", """WITH f AS (SELECT vehicle_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY vehicle_id ORDER BY t) <= 20 THEN 0 ELSE 1 END AS n FROM fx WHERE event_id % 101 <> 0), s AS (SELECT *, sum(n) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT vehicle_id, min(t) AS start, max(t) AS "end", count(*) AS fixes FROM s GROUP BY vehicle_id, k""")
def live_sessions(s, d):
    return V.live_sessions(X.fixes(s, d).where("event_id % 101 <> 0"))


@query("live_edge_speed", """WITH m AS (SELECT edge, t, avg(speed_mps) AS v FROM st GROUP BY ALL), gr AS (SELECT e.edge, z.t, m.v FROM (SELECT DISTINCT edge FROM m) e CROSS JOIN range(0, 120) AS z(t) LEFT JOIN m ON m.edge = e.edge AND m.t = z.t),
    r AS (SELECT edge, t, v, CASE WHEN v IS NULL THEN 12.5 ELSE 12.5 + 0.1 * (v - 12.5) END::DOUBLE AS live FROM gr WHERE t = 0 UNION ALL SELECT gr.edge, gr.t, gr.v, CASE WHEN gr.v IS NULL THEN r.live + 0.1 * (12.5 - r.live) ELSE r.live + 0.1 * (gr.v - r.live) END FROM r JOIN gr ON gr.edge = r.edge AND gr.t = r.t + 1)
    SELECT edge, t AS tick, round(live, 4) AS live_mps FROM r WHERE v IS NOT NULL""", recursive=True)
def live_edge_speed(s, d):
    return V.live_edge_speed(X.states(s, d), 12.5).select("edge", "tick", *r4("live_mps"))


@query("edge_tumbling_stats", "SELECT edge, s AS start, count(*) AS n, round(avg(speed_mps), 4) AS avg_mps FROM st, range(-10, 120, 10) AS z(s) WHERE t >= s AND t < s + 20 GROUP BY ALL")
def edge_tumbling_stats(s, d):
    return V.edge_tumbling_stats(X.states(s, d), 20, 10).select("edge", "start", "n", *r4("avg_mps"))


@query("lane_neighbors", "SELECT a.t, a.vehicle_id, (SELECT b.vehicle_id FROM st b WHERE b.t = a.t AND b.edge = a.edge AND b.lane = a.lane AND (b.dist, b.vehicle_id) > (a.dist, a.vehicle_id) ORDER BY b.dist, b.vehicle_id LIMIT 1) AS ahead_id FROM st a")
def lane_neighbors(s, d):
    return V.lane_neighbors(X.states(s, d)).select("t", "vehicle_id", "ahead_id")


@query("negative_gaps", "WITH n AS (SELECT t, vehicle_id, lead(dist) OVER (PARTITION BY t, edge, lane ORDER BY dist, vehicle_id) - 4.5 - dist AS gap_m FROM st) SELECT * FROM n WHERE gap_m < 0")
def negative_gaps(s, d):
    return V.negative_gaps(X.states(s, d))


@query("stuck_vehicles", """WITH a AS (SELECT vehicle_id, t FROM st WHERE speed_mps < 0.5), b AS (SELECT *, t - row_number() OVER (PARTITION BY vehicle_id ORDER BY t) AS g FROM a) SELECT vehicle_id, min(t) AS start, max(t) AS "end", count(*)::DOUBLE AS stopped_sec FROM b GROUP BY vehicle_id, g HAVING count(*) > 5""")
def stuck_vehicles(s, d):
    return V.stuck_vehicles(X.states(s, d))


@query("interval_stats", """SELECT t, (SELECT count(*) FROM tr WHERE spawn_t <= z.t) - (SELECT count(*) FROM tr WHERE completed AND spawn_t + duration <= z.t) AS active, (SELECT count(*) FROM tr WHERE spawn_t <= z.t) AS spawned, (SELECT count(*) FROM tr WHERE completed AND spawn_t + duration <= z.t) AS completed, round((SELECT avg(duration) FROM tr WHERE completed AND spawn_t + duration <= z.t), 4) AS avg_trip_sec FROM range(0, 901, 60) AS z(t)""")
def interval_stats(s, d):
    return V.interval_stats(X.trips(s, d), 60, 900).select("t", "active", "spawned", "completed", *r4("avg_trip_sec"))


@query("trip_stats", "SELECT vehicle_type, count(*) AS n, round(avg(duration), 4) AS avg_trip_sec FROM tr WHERE completed GROUP BY ROLLUP (vehicle_type)")
def trip_stats(s, d):
    return V.trip_stats(X.trips(s, d)).select("vehicle_type", "n", *r4("avg_trip_sec"))


@query("emergency_stats", """SELECT vehicle_type, count(*) AS n, round(avg(40 + trip_id % 50), 4) AS avg_response_sec, round(avg(100 + trip_id % 30), 4) AS avg_transport_sec FROM tr WHERE vehicle_type IN ('ambulance', 'firetruck', 'police') AND trip_id % 5 <> 0 GROUP BY GROUPING SETS ((vehicle_type), ())""")
def emergency_stats(s, d):
    t = X.trips(s, d).where("vehicle_type in ('ambulance', 'firetruck', 'police')")
    arrival, depot = F.col("spawn_t") + 40 + F.col("trip_id") % 50, F.col("spawn_t") + 140 + F.col("trip_id") % 50 + F.col("trip_id") % 30
    steps = F.array(F.struct(F.lit("dispatch").alias("event"), F.col("spawn_t").alias("t")), F.struct(F.lit("incident_arrival").alias("event"), arrival.alias("t")), F.struct(F.when(F.col("completed"), "depot_arrival").otherwise("recall").alias("event"), depot.alias("t")))
    e = t.select(F.col("trip_id").alias("vehicle_id"), "vehicle_type", F.lit(0).alias("incident_id"), F.explode(steps).alias("e")).select("vehicle_id", "vehicle_type", "incident_id", "e.event", "e.t")
    return V.emergency_stats(e).select("vehicle_type", "n", *r4("avg_response_sec", "avg_transport_sec"))


@query("vehicle_trace", "SELECT vehicle_id, t AS sec, round(speed_mps * 3.6, 4) AS kmh, round(speed_mps - lag(speed_mps) OVER (PARTITION BY vehicle_id ORDER BY t), 4) AS accel FROM st WHERE vehicle_id % 9 = 0")
def vehicle_trace(s, d):
    st = X.states(s, d)
    return V.vehicle_trace(st, st.where("vehicle_id % 9 = 0").select("vehicle_id").distinct()).select("vehicle_id", "sec", *r4("kmh", "accel"))


@query("dispatch_top", """WITH v AS (SELECT DISTINCT ON (vehicle_id) * FROM fx WHERE vehicle_type IN ('ambulance', 'firetruck', 'police') ORDER BY vehicle_id, t DESC),
    r AS (SELECT incident_id, v.vehicle_type AS type, v.vehicle_id, (v.x - i.x)^2 + (v.y - i.y)^2 AS d2 FROM inc i, v), k AS (SELECT *, row_number() OVER (PARTITION BY incident_id, type ORDER BY d2, vehicle_id) AS rank FROM r WHERE d2 <= 360000)
    SELECT incident_id, type, vehicle_id, rank, round(sqrt(d2), 4) AS dist_m FROM k WHERE rank <= 2""")
def dispatch_top(s, d):
    f = X.fixes(s, d).select("vehicle_id", "vehicle_type", "t", "x", "y")
    return V.dispatch_top(X.incidents(s, d), V.latest_wins_upsert(f, None, "vehicle_id", "t"), 2, 600.0).select("incident_id", "type", "vehicle_id", F.col("rank").cast("long").alias("rank"), *r4("dist_m"))


def _celled(columns: str, cell: int) -> str:
    """p: states with a place, k: their cells, a: each state in its own and the eight cells around."""
    return f"""p AS (SELECT t, vehicle_id AS id, {columns} FROM st), k AS (SELECT *, floor(x / {cell}) AS cx, floor(y / {cell}) AS cy FROM p),
    a AS (SELECT k.* REPLACE (cx + i AS cx, cy + j AS cy) FROM k, (VALUES (-1), (0), (1)) AS q(i), (VALUES (-1), (0), (1)) AS z(j))"""


@query("close_pairs", f"""WITH {_celled("edge * 40.0 + dist AS x, lane * 3.0 AS y", 20)} SELECT t, a.id AS id_a, k.id AS id_b, round(sqrt((a.x - k.x)^2 + (a.y - k.y)^2), 4) AS dist_m FROM a JOIN k USING (t, cx, cy) WHERE a.id < k.id AND (a.x - k.x)^2 + (a.y - k.y)^2 < 400""")
def close_pairs(s, d):
    p = X.states(s, d).selectExpr("t", "vehicle_id AS id", "CAST(edge * 40 + dist AS DOUBLE) AS x", "CAST(lane * 3 AS DOUBLE) AS y")
    return J.close_pairs(p, 20.0, 4)


@query("vision_cone", f"""WITH {_celled("edge * 40.0 + dist AS x, lane * 3.0 AS y, 0.1 * (vehicle_id % 60) AS h, speed_mps AS v", 50)},
    q AS (SELECT t, a.id, k.id AS other_id, sqrt((a.x - k.x)^2 + (a.y - k.y)^2) AS d, atan2(k.y - a.y, k.x - a.x) - a.h AS u, k.v * (cos(k.h) * (a.x - k.x) + sin(k.h) * (a.y - k.y)) AS c FROM a JOIN k USING (t, cx, cy) WHERE a.id <> k.id),
    z AS (SELECT *, u - 2 * pi() * floor((u + pi()) / (2 * pi())) AS w FROM q WHERE d <= 50) SELECT t, id, other_id, round(d, 4) AS dist_m, round(w, 4) + 0 AS bearing, round(c / greatest(1e-6, d), 4) + 0 AS closing_mps FROM z WHERE abs(w) <= 0.45""")
def vision_cone(s, d):
    p = X.states(s, d).selectExpr("t", "vehicle_id AS id", "CAST(edge * 40 + dist AS DOUBLE) AS x", "CAST(lane * 3 AS DOUBLE) AS y", "0.1D * (vehicle_id % 60) AS heading", "speed_mps")
    return J.vision_cone(p, p, 0.45, 50.0, 4)


@query("apportion_counts", """WITH v AS (SELECT * FROM (VALUES (0, 'car', 0.82), (1, 'motorcycle', 0.10), (2, 'bus', 0.03), (3, 'truck', 0.03), (4, 'ambulance', 0.02), (5, 'firetruck', 0.015), (6, 'police', 0.015)) AS q(i, type, w)), a AS (SELECT *, (SELECT count(*) FROM orders)::DOUBLE * w::DOUBLE / (SELECT sum(w::DOUBLE) FROM v) AS raw FROM v),
    b AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, i) AS k, (SELECT count(*) FROM orders) - (SELECT sum(floor(raw)) FROM a) AS rest FROM a) SELECT type, CAST(floor(raw) + (k <= rest)::INT AS BIGINT) AS n FROM b""")
def apportion_counts(s, d):
    return T.apportion_counts(s, s.read.parquet(f"{d}/orders.parquet").count())


@query("find_depots", """WITH h AS (SELECT 'hospital' AS kind, amenity_id AS depot_id, x, y FROM am WHERE amenity = 'hospital' UNION ALL SELECT 'hospital', building_id, cx, cy FROM bl WHERE building = 'hospital' AND building_id NOT IN (SELECT building_id FROM am WHERE amenity = 'hospital' AND building_id IS NOT NULL) UNION ALL SELECT k, amenity_id, x, y FROM am, (VALUES ('police'), ('fire_station')) AS q(k) WHERE amenity = 'police')
    SELECT CASE kind WHEN 'hospital' THEN 'ambulance' WHEN 'police' THEN 'police' ELSE 'firetruck' END AS type, depot_id, b.node_id FROM h, LATERAL (SELECT node_id FROM nd ORDER BY (nd.x - h.x)^2 + (nd.y - h.y)^2, node_id LIMIT 1) b""")
def find_depots(s, d):
    return T.find_depots(X.amenities(s, d), X.buildings(s, d), X.nodes(s, d)).select("type", "depot_id", "node_id")


@query("assign_depots", """WITH dp AS (SELECT k AS type, amenity_id, row_number() OVER (PARTITION BY k ORDER BY amenity_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM am, (VALUES ('police'), ('firetruck'), ('ambulance')) AS q(k) WHERE amenity = CASE k WHEN 'ambulance' THEN 'hospital' ELSE 'police' END), v AS (SELECT trip_id AS id, vehicle_type AS type, row_number() OVER (PARTITION BY vehicle_type ORDER BY trip_id) - 1 AS j FROM tr)
    SELECT id, amenity_id AS depot_id FROM v JOIN dp ON dp.type = v.type AND v.j % dp.n = dp.i""")
def assign_depots(s, d):
    a = X.amenities(s, d)
    kind = tag("amenity")
    depots = a.where(kind.isin("police", "hospital")).select(F.explode(F.when(kind == "police", F.array(F.lit("police"), F.lit("firetruck"))).otherwise(F.array(F.lit("ambulance")))).alias("type"), F.col("amenity_id").alias("depot_id"), F.lit("n0").alias("node_id"))
    return T.assign_depots(X.trips(s, d).select(F.col("trip_id").alias("id"), F.col("vehicle_type").alias("type")), depots).select("id", "depot_id")


@query("trip_summary", "SELECT vehicle_type, count(*) AS n, round(min(d), 4) AS min_m, round(max(d), 4) AS max_m, round(avg(d), 4) AS avg_m FROM (SELECT vehicle_type, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS d FROM tr JOIN nd a ON a.node_id = start_node JOIN nd b ON b.node_id = end_node) GROUP BY 1")
def trip_summary(s, d):
    return T.trip_summary(X.trips(s, d), X.nodes(s, d)).select("vehicle_type", "n", *r4("min_m", "max_m", "avg_m"))


@query("network_by_class", "SELECT highway, count(*) AS edges, round(sum(d), 2) AS length_m, round(sum(weight), 2) AS seconds FROM edge GROUP BY 1")
def flagship(s, d):
    """Directed edges of the routing graph by road class: read, walk the ways, weigh, add up."""
    e = G.routing_edges(X.nodes(s, d), X.ways(s, d)).where("kind = 'chain'")
    c = G.chain_edges(X.nodes(s, d), X.ways(s, d)).groupBy("way_id").agg(F.sum("length_m").alias("m"))
    per = e.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight_sec").alias("sec")).join(c, "way_id").join(X.ways(s, d).select("way_id", tag("highway").alias("highway")), "way_id")
    return per.groupBy("highway").agg(F.sum("n").alias("edges"), F.round(F.sum("m"), 2).alias("length_m"), F.round(F.sum("sec"), 2).alias("seconds"))
