"""Routes that begin or end in mid-road: virtual endpoints, their seeds, travel along one segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import backward, distance, forward, speed_kmh, tag
from roadspark.operators.cuts import place_on_ways
from roadspark.operators.graph import shortest_paths


def virtual_endpoints(points: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """point_id, way_id, node_a, node_b, to_a_sec, to_b_sec, directions (AtoB, BtoA, both), x, y of points on roads.

    points: point_id, way_id, x, y. The nearest segment's nodes bracket the point; on a divided two-way road the side that
    it lies on settles the direction, and x, y move a quarter of the road's width to the left of it.
    """
    lanes, wide = F.coalesce(tag("lanes").try_cast("double"), F.lit(2.0)), F.coalesce(tag("lane_width").try_cast("double"), F.lit(C.LANE_WIDTH_M))
    divided = (F.coalesce(tag("divider"), F.lit("")) == "yes") & (F.coalesce(tag("oneway"), F.lit("")) != "yes")
    about = ways.select("way_id", "nodes", (speed_kmh() / 3.6).alias("mps"), forward().alias("fwd"), backward().alias("bwd"), divided.alias("divided"), (lanes * wide / 4).alias("aside"))
    c = F.col
    p = place_on_ways(points, ways, nodes).join(about, "way_id")
    ex, ey, length = c("bx") - c("ax"), c("by") - c("ay"), distance(c("ax"), c("ay"), c("bx"), c("by"))
    left = ex * (c("y") - c("ay")) - ey * (c("x") - c("ax")) >= 0
    directions = F.when(c("fwd") & ~c("bwd"), "AtoB").when(c("bwd") & ~c("fwd"), "BtoA").when(c("divided"), F.when(left, "AtoB").otherwise("BtoA")).otherwise("both")
    p = p.withColumns({"directions": directions, "len": length}).withColumn("shift", F.when(c("divided"), F.when(c("directions") == "AtoB", 1).otherwise(-1) * c("aside") / F.greatest(F.lit(1e-6), c("len"))).otherwise(0.0))
    return p.select(
        "point_id", "way_id", F.get("nodes", c("seq")).alias("node_a"), F.get("nodes", c("seq") + 1).alias("node_b"), (c("u") * c("len") / c("mps")).alias("to_a_sec"), ((1 - c("u")) * c("len") / c("mps")).alias("to_b_sec"),
        "directions", (c("px") - ey * c("shift")).alias("x"), (c("py") + ex * c("shift")).alias("y"),
    )


def endpoint_seeds(endpoints: DataFrame, edges: DataFrame, start: bool) -> DataFrame:
    """point_id, node_id, cost_sec: graph nodes where a route from (start) or to an endpoint begins or ends.

    endpoints: point_id, and node_id for a node, or node_a, node_b, to_a_sec, to_b_sec, directions. A node gives itself and its
    twins. A virtual one gives the nodes that its directions allow, the twin of that direction where there is one, and
    nothing unless both its nodes are known to the graph.
    """
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    known = ids.select(F.regexp_replace("id", "#(fwd|bwd)$", "").alias("id")).distinct()
    twins = F.array("node_id", F.concat("node_id", F.lit("#fwd")), F.concat("node_id", F.lit("#bwd")))
    plain = endpoints.where("node_id is not null").select("point_id", F.explode(twins).alias("node_id"), F.lit(0.0).alias("cost_sec")).join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    out, into = ("AtoB", "BtoA") if start else ("BtoA", "AtoB")
    side = lambda way, node, cost, twin: F.when(F.col("directions").isin("both", way), F.struct(F.col(node).alias("plain"), F.concat(node, F.lit(twin)).alias("twin"), F.col(cost).alias("cost_sec")))
    # towards B the forward chain is left (start) or reached (end); towards A it is the other one
    a, b = side(into, "node_a", "to_a_sec", "#bwd" if start else "#fwd"), side(out, "node_b", "to_b_sec", "#fwd" if start else "#bwd")
    bracketed = endpoints.where("node_id is null").join(known.withColumnRenamed("id", "node_a"), "node_a", "left_semi").join(known.withColumnRenamed("id", "node_b"), "node_b", "left_semi")
    each = bracketed.select("point_id", F.explode(F.filter(F.array(a, b), lambda e: e.isNotNull())).alias("e")).select("point_id", "e.*")
    virtual = each.join(ids.select(F.col("id").alias("twin"), F.lit(True).alias("has")), "twin", "left").select("point_id", F.when(F.col("has"), F.col("twin")).otherwise(F.col("plain")).alias("node_id"), "cost_sec")
    return plain.select("point_id", "node_id", "cost_sec").unionByName(virtual)


def _legal(directions: Column, toward_b: Column) -> Column:
    return (directions == "both") | (toward_b & (directions == "AtoB")) | (~toward_b & (directions == "BtoA"))


def same_edge_direct(od: DataFrame, endpoints: DataFrame) -> DataFrame:
    """od_id, cost_sec: travel between two virtual endpoints of one segment, where its directions allow it. od: od_id, start_id, end_id."""
    at = lambda p: endpoints.where("node_a is not null").select(F.col("point_id").alias(f"{p}_id"), "node_a", "node_b", *(F.col(c).alias(f"{p}_{c}") for c in ("to_a_sec", "to_b_sec", "directions")))
    both = od.select("od_id", "start_id", "end_id").join(at("start"), "start_id").join(at("end"), ["end_id", "node_a", "node_b"])
    return both.where(_legal(F.col("start_directions"), F.col("end_to_b_sec") < F.col("start_to_b_sec"))).select("od_id", F.abs(F.col("start_to_a_sec") - F.col("end_to_a_sec")).alias("cost_sec"))


def seeded_costs(edges: DataFrame, od: DataFrame, endpoints: DataFrame) -> DataFrame:
    """od_id, found, cost_sec: the least of all seeds' routes and of direct travel. od: od_id, start_id, end_id."""
    a = endpoint_seeds(endpoints, edges, True).select(F.col("point_id").alias("start_id"), F.col("node_id").alias("src"), F.col("cost_sec").alias("before"))
    b = endpoint_seeds(endpoints, edges, False).select(F.col("point_id").alias("end_id"), F.col("node_id").alias("dst"), F.col("cost_sec").alias("after"))
    legs = od.join(a, "start_id").join(b, "end_id")
    pairs = legs.select("src", "dst").distinct().withColumn("od_id", F.struct("src", "dst"))
    ways = shortest_paths(edges, pairs).where("found").select("od_id.src", "od_id.dst", "cost_sec")
    through = legs.join(ways, ["src", "dst"]).select("od_id", (F.col("before") + F.col("cost_sec") + F.col("after")).alias("cost_sec"))
    best = through.unionByName(same_edge_direct(od, endpoints)).groupBy("od_id").agg(F.min("cost_sec").alias("cost_sec"))
    return od.select("od_id").join(best, "od_id", "left").select("od_id", F.col("cost_sec").isNotNull().alias("found"), "cost_sec")
