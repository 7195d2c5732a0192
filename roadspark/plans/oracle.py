"""DuckDB SQL of the derived tables, and of the queries over them, written apart from the Spark code."""

from __future__ import annotations

import re

H = "(60 * ((SELECT count(*) FROM customer) // 40))"
TYPE = "(['car','motorcycle','bus','truck','ambulance','firetruck','police'])[CAST({} % 7 AS INT) + 1]"

TABLES = {
    "g": "SELECT c_custkey AS k, c_custkey % 40 AS col, c_custkey // 40 AS r, (c_custkey % 40 * 60 - ((c_custkey % 40) // 10) * 51 + c_nationkey % 4)::DOUBLE AS x, ((c_custkey // 40) * 60 + (c_custkey * 7) % 4)::DOUBLE AS y FROM customer",
    "nd": "SELECT 'n' || k AS node_id, k, col, r, x, y, 12.9 + y * 1e-5 AS lat, 77.6 + x * 1e-5 AS lon FROM g",
    "wn0": "SELECT 'h' || r AS way_id, node_id, row_number() OVER (PARTITION BY r ORDER BY col) - 1 AS seq, count(*) OVER (PARTITION BY r) AS n, r AS a, 'h' AS d FROM nd UNION ALL SELECT 'v' || col, node_id, row_number() OVER (PARTITION BY col ORDER BY r) - 1, count(*) OVER (PARTITION BY col), col, 'v' FROM nd",
    "wn": "SELECT way_id, node_id, seq, n, x, y FROM wn0 JOIN nd USING (node_id) WHERE n >= 2",
    "w": """SELECT DISTINCT way_id, n, CASE d WHEN 'h' THEN a ELSE 1000000 + a END AS ord,
        CASE d WHEN 'h' THEN (['trunk','primary','secondary','tertiary','residential','footway'])[CAST(a % 6 AS INT) + 1] ELSE (['secondary','residential','service','residential','tertiary'])[CAST(a % 5 AS INT) + 1] END AS highway,
        CASE WHEN d = 'h' AND a % 8 = 3 THEN '-1' WHEN d = 'h' AND a % 4 = 1 THEN 'yes' WHEN d = 'v' AND a % 7 = 2 THEN 'yes' END AS oneway,
        CASE WHEN d = 'h' AND a % 12 = 6 THEN 'yes' END AS bridge,
        CASE WHEN d = 'h' AND a % 6 = 2 THEN 'yes' WHEN d = 'v' AND a % 10 = 0 THEN 'yes' END AS divider,
        CASE WHEN d = 'h' AND a % 3 = 0 THEN '50' WHEN d = 'h' AND a % 3 = 2 THEN 'abc' WHEN d = 'v' AND a % 3 = 0 THEN '40' END AS maxspeed,
        CASE WHEN d = 'h' AND a % 16 = 12 THEN 'no' END AS access, CASE WHEN d = 'h' AND a % 4 = 0 THEN '4' END AS lanes FROM wn0 WHERE n >= 2""",
    "ws": """SELECT *, coalesce(CASE WHEN maxspeed IN ('50', '40') THEN maxspeed::DOUBLE END, CASE highway WHEN 'residential' THEN 35 WHEN 'service' THEN 35 WHEN 'footway' THEN 30 ELSE 60 END)::DOUBLE AS kmh,
        coalesce(oneway, '') <> '-1' AS fwd, coalesce(oneway, '') <> 'yes' AS bwd FROM w""",
    "rw": "SELECT * FROM ws WHERE highway <> 'footway' AND access IS NULL",
    "veh": "SELECT * FROM w WHERE highway <> 'footway'",
    "seg": "SELECT a.way_id, a.seq, a.node_id AS na, b.node_id AS nb, a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy, a.n, sqrt((a.x-b.x)^2 + (a.y-b.y)^2) AS d FROM wn a JOIN wn b ON a.way_id = b.way_id AND b.seq = a.seq + 1",
    "bl": """SELECT 'b_' || p_partkey AS building_id, p_partkey AS ord, CASE split_part(p_type, ' ', 1) WHEN 'MEDIUM' THEN 'residential' WHEN 'PROMO' THEN 'retail' WHEN 'LARGE' THEN 'hospital' ELSE 'yes' END AS building,
        p_brand AS brand, p_size::DOUBLE AS s, ((p_partkey * 37) % 2200)::DOUBLE AS cx, ((p_partkey * 53) % """ + H + """)::DOUBLE AS cy FROM part""",
    "am": "SELECT 'a_' || s_suppkey AS amenity_id, s_suppkey AS ord, ((s_suppkey * 211) % 2200)::DOUBLE AS x, ((s_suppkey * 97) % " + H + ")::DOUBLE AS y, (['hospital','police','clinic','cafe','school'])[CAST(s_suppkey % 5 AS INT) + 1] AS amenity, CASE WHEN s_suppkey % 3 <> 0 THEN 'A' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'b_' || ((s_suppkey * 7) % (SELECT count(*) FROM part)) END AS building_id FROM supplier",
    "sg": "SELECT node_id, k, r, col, k % 2 = 0 AS paired, (20 + k % 11)::DOUBLE AS green, (10 + k % 6)::DOUBLE AS step FROM nd WHERE r % 3 = 0 AND col % 5 = 0",
    "tr": "SELECT o_orderkey AS trip_id, 'n' || o_custkey AS start_node, 'n' || ((o_custkey * 31 + o_orderkey * 17 + 7) % (SELECT count(*) FROM customer)) AS end_node, " + TYPE.format("o_orderkey") + " AS vehicle_type, (o_orderkey * 3) % 600 AS spawn_t, 30 + (o_orderkey * 11) % 400 AS duration, o_orderkey % 5 <> 0 AS completed FROM orders",
    "fx": "SELECT event_id, event_id AS t, 'FV-' || user_id AS vehicle_id, " + TYPE.format("user_id") + " AS vehicle_type, ((user_id * 131 + event_id * 17) % 2200)::DOUBLE AS x, ((user_id * 71 + event_id * 29) % " + H + ")::DOUBLE AS y, CASE WHEN event_id % 9 <> 0 THEN ((event_id * 37) % 720 - 180)::DOUBLE END AS heading, value::DOUBLE % 60 AS speed_kmh, event_type FROM events",
    "st": "SELECT t, user_id AS vehicle_id, " + TYPE.format("user_id") + " AS vehicle_type, CASE WHEN ((t // 12) + user_id) % 3 = 0 AND t % 12 < 4 + user_id % 8 THEN 0.0 ELSE ((user_id * 7 + t * 13) % 40)::DOUBLE / 3.0 + 0.6 END AS speed_mps, (user_id + t // 12) % 50 AS edge, user_id % 2 AS lane, ((user_id * 13 + t * 5) % 60)::DOUBLE AS dist FROM (SELECT DISTINCT user_id FROM events), range(0, 120) AS q(t)",
    "inc": "SELECT event_id AS incident_id, x, y, t FROM fx WHERE event_type = 'error'",
    "piece": """SELECT f.way_id, f.seq, f.node_id, f.cut, coalesce(sum(f.cut) OVER (PARTITION BY f.way_id ORDER BY f.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM
        (SELECT wn.*, (wn.seq > 0 AND wn.seq < wn.n - 1 AND (SELECT count(DISTINCT o.way_id) FROM wn o JOIN veh USING (way_id) WHERE o.node_id = wn.node_id) >= 2)::INT AS cut FROM wn WHERE way_id IN (SELECT way_id FROM veh)) f""",
    "edge": """SELECT CASE WHEN f THEN sa ELSE sb END AS src, CASE WHEN f THEN sb ELSE sa END AS dst, d / (kmh / 3.6) AS weight, seg_way AS way_id, seq, f, d, kmh / 3.6 AS mps, highway, lanes, fwd AND bwd AS two FROM
        (SELECT s.way_id AS seg_way, s.seq, s.d, r.kmh, r.highway, r.lanes, r.fwd, r.bwd, f, s.na || CASE WHEN r.divider = 'yes' AND r.fwd AND r.bwd AND s.seq > 0 THEN CASE WHEN f THEN '#fwd' ELSE '#bwd' END ELSE '' END AS sa,
                s.nb || CASE WHEN r.divider = 'yes' AND r.fwd AND r.bwd AND s.seq + 1 < s.n - 1 THEN CASE WHEN f THEN '#fwd' ELSE '#bwd' END ELSE '' END AS sb
         FROM seg s JOIN rw r USING (way_id), (VALUES (true), (false)) AS q(f) WHERE (f AND r.fwd) OR (NOT f AND r.bwd))""",
}


def sql(body: str, recursive: bool = False) -> str:
    """body behind the derived tables it names, directly or through others."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                need(TABLES[name])
                if name not in wanted:
                    wanted.append(name)

    need(body)
    order = [t for t in TABLES if t in wanted]
    head = ", ".join(f"{t} AS ({TABLES[t]})" for t in order)
    extra = body.strip()
    if not head and recursive:
        return extra.replace("WITH ", "WITH RECURSIVE ", 1)
    if extra.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {extra[5:]}" if head else extra
    return f"WITH {head} {extra}" if head else extra
