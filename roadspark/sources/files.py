"""Readers and writers: OSM XML, trip manifests, state ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "array<struct<_k:string,_v:string>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(osm_nodes, osm_ways, feature_ways, bounds) of an OSM XML extract; relations aren't read.

    Ways with a highway tag and two nodes or more are roads; others with a building or amenity tag and three or more are
    features. ord follows the file's order.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    tags = F.coalesce(F.map_from_entries(F.transform(F.col("tag"), lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>")).alias("tags")
    nodes = xml("node", f"_id string, _lat double, _lon double, tag {_TAG}").select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags)
    ways = xml("way", f"_id string, nd array<struct<_ref:string>>, tag {_TAG}").select(F.col("_id").alias("way_id"), F.monotonically_increasing_id().alias("ord"), tags, F.coalesce(F.col("nd._ref"), F.array().cast("array<string>")).alias("nodes"))
    has = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")) != ""
    roads = ways.where(has("highway") & (F.size("nodes") >= 2))
    features = ways.where(~has("highway") & (has("building") | has("amenity")) & (F.size("nodes") >= 3))
    bounds = xml("bounds", "_minlat double, _minlon double, _maxlat double, _maxlon double").select(*(F.col(f"_{c}").alias(c) for c in ("minlat", "minlon", "maxlat", "maxlon")))
    return nodes, roads, features, bounds


TRIP_DEFAULTS = {"vehicleType": "car", "length": 4.5, "width": 1.8, "maxSpeedKmh": 140.0}
TRIPS = "id long, vehicleType string, startNodeId string, endNodeId string, length double, width double, maxSpeedKmh double, homeAmenityId string"


def write_trips(trips: DataFrame, path: str, fmt: str) -> None:
    """A manifest as CSV with a header (nulls as empty fields) or JSON lines."""
    writer = trips.write.mode("errorifexists")
    writer.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path) if fmt == "csv" else writer.json(path)


def read_trips(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A manifest with missing values filled: type car, length 4.5, width 1.8, top speed 140."""
    raw = spark.read.schema(TRIPS)
    df = raw.option("header", True).csv(path) if fmt == "csv" else raw.json(path)
    return df.select(*(F.coalesce(c, F.lit(TRIP_DEFAULTS[c])).alias(c) if c in TRIP_DEFAULTS else F.col(c) for c in df.columns))


STATE = "t double, spawned long, completed long, vehicles array<struct<id:string,x:double,y:double,s:double,ty:string,em:int,stk:int>>, lamps array<struct<nodeId:string,wayId:string,movement:string,color:string,r:double>>, approachWeights array<struct<nodeId:string,wayId:string,weight:double>>"


def parse_state_ticks(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(header, vehicle_states, lamp_states, approach_weights) of state messages in the column value; flags are false where absent."""
    m = raw.select(F.from_json("value", STATE).alias("m")).select("m.*")
    each = lambda c: m.select("t", F.explode(c).alias("e"))
    flag = lambda c: F.coalesce(F.col(f"e.{c}") == 1, F.lit(False))
    vehicles = each("vehicles").select("t", "e.id", "e.x", "e.y", F.col("e.s").alias("speed_mps"), F.col("e.ty").alias("type"), flag("em").alias("emergency"), flag("stk").alias("stuck"))
    lamps = each("lamps").select("t", F.col("e.nodeId").alias("node_id"), F.col("e.wayId").alias("way_id"), "e.movement", "e.color", F.col("e.r").alias("remaining_sec"))
    weights = each("approachWeights").select("t", F.col("e.nodeId").alias("junction_id"), F.col("e.wayId").alias("way_id"), "e.weight")
    return m.select("t", "spawned", "completed", F.size("vehicles").alias("n_vehicles")), vehicles, lamps, weights
