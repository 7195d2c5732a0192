"""Road and fleet tables derived from the given ones by exact integer arithmetic (FIXTURES.md), for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, col, r, x, y of each node."""
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey % 40 AS col", "c_custkey div 40 AS r", "c_nationkey AS nation")
    return c.selectExpr("k", "col", "r", "CAST(col * 60 - (col div 10) * 51 + nation % 4 AS DOUBLE) AS x", "CAST(r * 60 + (k * 7) % 4 AS DOUBLE) AS y")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y, lat, lon, tags."""
    return grid(spark, sf_dir).selectExpr("concat('n', k) AS node_id", "x", "y", "12.9 + y * 1e-5 AS lat", "77.6 + x * 1e-5 AS lon", "CAST(map() AS map<string,string>) AS tags")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, ord, tags, nodes: streets and avenues of the grid."""
    g = grid(spark, sf_dir)
    street = g.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("col", F.concat(F.lit("n"), "k").alias("id")))).alias("s")).where("size(s) >= 2").selectExpr(
        "concat('h', r) AS way_id", "r AS ord", "transform(s, e -> e.id) AS nodes",
        """map_filter(map('highway', element_at(array('trunk','primary','secondary','tertiary','residential','footway'), CAST(r % 6 AS INT) + 1),
               'oneway', CASE WHEN r % 8 = 3 THEN '-1' WHEN r % 4 = 1 THEN 'yes' END, 'bridge', CASE WHEN r % 12 = 6 THEN 'yes' END,
               'divider', CASE WHEN r % 6 = 2 THEN 'yes' END, 'maxspeed', CASE r % 3 WHEN 0 THEN '50' WHEN 2 THEN 'abc' END,
               'access', CASE WHEN r % 16 = 12 THEN 'no' END, 'lanes', CASE WHEN r % 4 = 0 THEN '4' END), (k, v) -> v IS NOT NULL) AS tags""",
    )
    avenue = g.groupBy("col").agg(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("n"), "k").alias("id")))).alias("s")).where("size(s) >= 2").selectExpr(
        "concat('v', col) AS way_id", "1000000 + col AS ord", "transform(s, e -> e.id) AS nodes",
        """map_filter(map('highway', element_at(array('secondary','residential','service','residential','tertiary'), CAST(col % 5 AS INT) + 1),
               'oneway', CASE WHEN col % 7 = 2 THEN 'yes' END, 'divider', CASE WHEN col % 10 = 0 THEN 'yes' END,
               'maxspeed', CASE WHEN col % 3 = 0 THEN '40' END), (k, v) -> v IS NOT NULL) AS tags""",
    )
    return street.unionByName(avenue).select("way_id", "ord", "tags", "nodes")


def _height(spark: SparkSession, sf_dir: str) -> int:
    return 60 * (_read(spark, sf_dir, "customer").count() // 40)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id, ord, tags, polygon, cx, cy, size: square footprints."""
    p = _read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_brand AS brand", "split(p_type, ' ')[0] AS kind", "CAST(p_size AS DOUBLE) AS size", "CAST((p_partkey * 37) % 2200 AS DOUBLE) AS cx", f"CAST((p_partkey * 53) % {_height(spark, sf_dir)} AS DOUBLE) AS cy")
    return p.selectExpr(
        "concat('b_', k) AS building_id", "k AS ord",
        """map_filter(map('building', CASE kind WHEN 'MEDIUM' THEN 'residential' WHEN 'PROMO' THEN 'retail' WHEN 'LARGE' THEN 'hospital' ELSE 'yes' END,
             'shop', CASE WHEN brand = 'Brand#1' THEN 'yes' END, 'office', CASE WHEN brand = 'Brand#2' THEN 'yes' END,
             'tourism', CASE WHEN brand = 'Brand#3' THEN 'hotel' END, 'leisure', CASE WHEN brand = 'Brand#4' THEN 'park' END), (k, v) -> v IS NOT NULL) AS tags""",
        "array(named_struct('x', cx - size / 2, 'y', cy - size / 2), named_struct('x', cx + size / 2, 'y', cy - size / 2), named_struct('x', cx + size / 2, 'y', cy + size / 2), named_struct('x', cx - size / 2, 'y', cy + size / 2)) AS polygon",
    )


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amenity_id, ord, x, y, tags, building_id."""
    parts = _read(spark, sf_dir, "part").count()
    return _read(spark, sf_dir, "supplier").selectExpr(
        "concat('a_', s_suppkey) AS amenity_id", "s_suppkey AS ord", "CAST((s_suppkey * 211) % 2200 AS DOUBLE) AS x", f"CAST((s_suppkey * 97) % {_height(spark, sf_dir)} AS DOUBLE) AS y",
        """map_filter(map('amenity', element_at(array('hospital','police','clinic','cafe','school'), CAST(s_suppkey % 5 AS INT) + 1),
             'name', CASE WHEN s_suppkey % 3 <> 0 THEN concat('A', s_suppkey) END), (k, v) -> v IS NOT NULL) AS tags""",
        f"CASE WHEN s_suppkey % 2 = 0 THEN concat('b_', (s_suppkey * 7) % {parts}) END AS building_id",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, scheme, all_red_sec, phases, paired, group_id, k, r, col."""
    g = grid(spark, sf_dir).where("r % 3 = 0 AND col % 5 = 0")
    return g.selectExpr(
        "concat('n', k) AS node_id", "CASE WHEN k % 2 = 0 THEN 'paired4way' ELSE 'phases' END AS scheme", "2.0D AS all_red_sec",
        """CASE WHEN k % 2 = 0 THEN array() ELSE array(
             named_struct('id', 'p0', 'wayIds', array(concat('h', r)), 'greenSec', CAST(20 + k % 11 AS DOUBLE), 'yellowSec', 3.0D),
             named_struct('id', 'p1', 'wayIds', array(concat('v', col)), 'greenSec', CAST(20 + k % 11 AS DOUBLE), 'yellowSec', 3.0D)) END AS phases""",
        """CASE WHEN k % 2 = 0 THEN named_struct('yellowSec', 3.0D, 'pairs', array(
             named_struct('wayIds', array(concat('h', r), concat('h', r, 'w')), 'stepSec', CAST(10 + k % 6 AS DOUBLE)),
             named_struct('wayIds', array(concat('v', col), concat('v', col, 's')), 'stepSec', CAST(10 + k % 6 AS DOUBLE)))) END AS paired""",
        "concat('g', r) AS group_id", "k", "r", "col",
    )


def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, member_ids, turn_sec, direction: the signals of one row."""
    s = signals(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node_id"))), lambda e: e["node_id"]).alias("member_ids"))
    return s.where("size(member_ids) >= 2").selectExpr("group_id", "member_ids", "30.0D AS turn_sec", "'cw' AS direction")


def _type(key: str) -> str:
    return f"element_at(array('car','motorcycle','bus','truck','ambulance','firetruck','police'), CAST({key} % 7 AS INT) + 1)"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, start_node, end_node, vehicle_type, spawn_t, duration, completed."""
    n = _read(spark, sf_dir, "customer").count()
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS trip_id", "concat('n', o_custkey) AS start_node", f"concat('n', (o_custkey * 31 + o_orderkey * 17 + 7) % {n}) AS end_node",
        f"{_type('o_orderkey')} AS vehicle_type", "(o_orderkey * 3) % 600 AS spawn_t", "30 + (o_orderkey * 11) % 400 AS duration", "o_orderkey % 5 <> 0 AS completed",
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, vehicle_id, vehicle_type, lat, lon, x, y, heading_deg, speed_kmh, ts, t (dense seconds)."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('FV-', user_id) AS vehicle_id", f"{_type('user_id')} AS vehicle_type",
        "CAST((user_id * 131 + event_id * 17) % 2200 AS DOUBLE) AS x", f"CAST((user_id * 71 + event_id * 29) % {_height(spark, sf_dir)} AS DOUBLE) AS y",
        "CASE WHEN event_id % 9 <> 0 THEN CAST((event_id * 37) % 720 - 180 AS DOUBLE) END AS heading_deg", "CAST(value AS DOUBLE) % 60 AS speed_kmh", "event_id AS t",
    ).selectExpr("*", "CASE WHEN event_id % 101 = 0 THEN 95.0D ELSE 12.9 + y * 1e-5 END AS lat", "77.6 + x * 1e-5 AS lon", "timestamp_seconds(1704067200 + t) AS ts")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, vehicle_id (user), vehicle_type, speed_mps, edge, lane, dist, length_m for ticks 0 to 119."""
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    ticks = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))).alias("t"))
    return ticks.selectExpr(
        "t", "user_id AS vehicle_id", f"{_type('user_id')} AS vehicle_type",
        "CASE WHEN ((t div 12) + user_id) % 3 = 0 AND t % 12 < 4 + user_id % 8 THEN 0.0D ELSE CAST((user_id * 7 + t * 13) % 40 AS DOUBLE) / 3.0D + 0.6D END AS speed_mps",
        "(user_id + t div 12) % 50 AS edge", "user_id % 2 AS lane", "CAST((user_id * 13 + t * 5) % 60 AS DOUBLE) AS dist", "4.5D AS length_m",
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incident_id, kind, x, y, t."""
    return _read(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "event_id AS incident_id", "element_at(array('fire','medical','accident','crime'), CAST(event_id % 4 AS INT) + 1) AS kind",
        "CAST((user_id * 131 + event_id * 17) % 2200 AS DOUBLE) AS x", f"CAST((user_id * 71 + event_id * 29) % {_height(spark, sf_dir)} AS DOUBLE) AS y", "event_id AS t",
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, action, force, node_id, token, controller, green_lamps, way_id: a third in the older form, some of them all red."""
    return _read(spark, sf_dir, "events").where("event_type IN ('click', 'purchase', 'signup')").selectExpr(
        "event_id", "CASE event_type WHEN 'signup' THEN 'release' ELSE 'override' END AS action", "event_type = 'purchase' OR event_type = 'signup' AND event_id % 7 = 0 AS force",
        "concat('n', event_id % 20) AS node_id", "concat('t', user_id % 5) AS token", "concat('c', user_id % 3) AS controller",
        "CASE WHEN event_id % 3 <> 0 THEN array(named_struct('wayId', concat('h', event_id % 4), 'movement', CASE WHEN event_id % 2 = 0 THEN 'through' ELSE 'right' END)) END AS green_lamps",
        "CASE WHEN event_id % 15 <> 0 THEN concat('v', event_id % 4) END AS way_id",
    )
