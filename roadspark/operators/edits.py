"""Batch edits of a map: footprints and amenities, merged nodes, moves, deletions, junction groups, sampled curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import tag
from roadspark.operators.mapbuild import located, way_nodes


def _square(x, y, half: float):
    return F.array(*(F.struct(F.bround(x + dx * half, 2).alias("x"), F.bround(y + dy * half, 2).alias("y")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def extract_buildings(feature_ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """building_id, tags, polygon: rings of feature ways (closing point dropped, three points or more), and a square per amenity node."""
    wanted = feature_ways.where(tag("building").isNotNull() | tag("amenity").isNotNull())
    points = way_nodes(wanted).join(nodes.select("node_id", F.struct(F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y")).alias("p")), "node_id")
    rings = points.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda e: e["p"]).alias("ring"))
    closed = (F.size("ring") >= 2) & (F.get("ring", F.lit(0)) == F.element_at("ring", -1))
    rings = rings.withColumn("polygon", F.when(closed, F.expr("slice(ring, 1, size(ring) - 1)")).otherwise(F.col("ring"))).where("size(polygon) >= 3")
    real = wanted.join(rings, "way_id").select(F.concat(F.lit("b_"), "way_id").alias("building_id"), "tags", "polygon")
    spots = nodes.where(tag("amenity").isNotNull()).select(F.concat(F.lit("bn_"), "node_id").alias("building_id"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), _square(F.col("x"), F.col("y"), 4.0).alias("polygon"))
    return real.unionByName(spots)


def extract_amenities(feature_ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """amenity_id, x, y, tags, building_id: the mean corner of each amenity footprint, and each amenity node."""
    mean = lambda c: F.bround(F.aggregate(F.col("polygon")[c], F.lit(0.0), lambda s, v: s + v) / F.size("polygon"), 2)
    rings = extract_buildings(feature_ways, nodes).where(F.col("building_id").startswith("b_") & tag("amenity").isNotNull())
    ways = rings.select(F.concat(F.lit("a_"), F.expr("substring(building_id, 3)"), F.lit("_c")).alias("amenity_id"), mean("x").alias("x"), mean("y").alias("y"), "tags", "building_id")
    spots = nodes.where(tag("amenity").isNotNull()).select(F.concat(F.lit("a_"), "node_id").alias("amenity_id"), F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), "tags", F.concat(F.lit("bn_"), "node_id").alias("building_id"))
    return ways.unionByName(spots)


def remap_nodes(nodes: DataFrame, ways: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) with from_id merged into into_id: repeats in a row go, ways of one node go, the target's tags win."""
    w = Window.partitionBy("way_id").orderBy("seq")
    moved = way_nodes(ways).join(mapping.withColumnRenamed("from_id", "node_id"), "node_id", "left").withColumn("node_id", F.coalesce("into_id", "node_id"))
    kept = moved.withColumn("same", F.coalesce(F.col("node_id") == F.lag("node_id").over(w), F.lit(False))).where("not same")
    chains = kept.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda e: e["node_id"]).alias("nodes")).where("size(nodes) >= 2")
    given = nodes.join(mapping, nodes["node_id"] == mapping["from_id"]).groupBy("into_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "tags")), lambda a, b: F.when(a["from_id"] < b["from_id"], -1).when(a["from_id"] > b["from_id"], 1).otherwise(0)).alias("g"))
    extra = F.aggregate("g", F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(e["tags"]), k)), e["tags"]))
    left = nodes.join(mapping.select(F.col("from_id").alias("node_id")), "node_id", "left_anti").join(given.withColumnRenamed("into_id", "node_id"), "node_id", "left")
    merged = F.when(F.col("g").isNull(), F.col("tags")).otherwise(F.map_concat(F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys("tags"), k)), F.col("tags")))
    return left.withColumn("tags", merged).select(*nodes.columns), ways.drop("nodes").join(chains, "way_id").select(*ways.columns)


def affine_move(table: DataFrame, selection: DataFrame, id_col: str, dx: float = 0.0, dy: float = 0.0, pivot: tuple[float, float] | None = None, angle: float = 0.0) -> DataFrame:
    """table with the selected points turned by angle (radians) about pivot, then moved by dx, dy."""
    px, py = pivot or (0.0, 0.0)
    on = table.join(selection.select(id_col).distinct().withColumn("__on", F.lit(True)), id_col, "left")
    c, s = math.cos(angle), math.sin(angle)
    ox, oy = F.col("x") - px, F.col("y") - py
    x, y = px + ox * c - oy * s + dx, py + ox * s + oy * c + dy
    return on.withColumns({"x": F.when(F.col("__on"), x).otherwise(F.col("x")), "y": F.when(F.col("__on"), y).otherwise(F.col("y"))}).select(*table.columns)


def cascade_delete(buildings: DataFrame, amenities: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buildings, amenities) without the selected (kind, id): a building takes its amenities along, an amenity its building."""
    picked = lambda k: selection.where(F.col("kind") == k).select("id")
    gone = picked("building").unionByName(amenities.join(picked("amenity"), F.col("amenity_id") == F.col("id"), "left_semi").where("building_id is not null").select(F.col("building_id").alias("id"))).distinct()
    left = buildings.join(gone, F.col("building_id") == F.col("id"), "left_anti")
    kept = amenities.join(gone, F.col("building_id") == F.col("id"), "left_anti").join(picked("amenity"), F.col("amenity_id") == F.col("id"), "left_anti")
    return left, kept


def curve_points(ways: DataFrame, nodes: DataFrame, steps: int = 8) -> DataFrame:
    """way_id, seq, x, y: a smooth curve through each way's nodes, `steps` points to a stretch (ends doubled beyond the way)."""
    w = Window.partitionBy("way_id").orderBy("seq")
    p = located(ways, nodes)
    for c in ("x", "y"):
        p = p.withColumns({f"{c}1": F.lead(c).over(w), f"{c}0": F.coalesce(F.lag(c).over(w), F.col(c)), f"{c}2": F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w))})
    k = p.withColumn("last", F.col("x1").isNull()).withColumn("k", F.explode(F.when(F.col("last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    t = F.col("k") / F.lit(float(steps))

    def at(c: str):
        a, b = F.col(c), F.col(f"{c}1")
        c1, c2 = a + (b - F.col(f"{c}0")) / 6, b - (F.col(f"{c}2") - a) / 6
        return F.when(F.col("last"), a).otherwise((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * b)

    return k.select("way_id", (F.col("seq") * steps + F.col("k")).alias("seq"), at("x").alias("x"), at("y").alias("y"))


def mixed_curve_points(ways: DataFrame, nodes: DataFrame, steps: int = 8, reach: float = 0.4) -> DataFrame:
    """way_id, seq, x, y: ways as they are drawn, each vertex smooth or sharp as its vertex_type (angle or curve) and its way's curve say.

    ways: way_id, nodes, curve (spline, else straight); nodes: node_id, x, y, tags. Ends are sharp. A spline runs smoothly through its vertices
    but for those of type angle, at which it breaks into pieces; a straight way is rounded at vertices of type curve: a
    quadratic corner from `reach` of the shorter stretch before to as much after. A way that lacks a node, or has fewer
    than two, is its points.
    """
    w = Window.partitionBy("way_id").orderBy("seq")
    whole = Window.partitionBy("way_id")
    shaped = located(ways, nodes).join(ways.select("way_id", (F.col("curve") == "spline").alias("spline"), F.size("nodes").alias("size")), "way_id").join(nodes.select("node_id", F.coalesce(tag("vertex_type"), F.lit("")).alias("type")), "node_id")
    p = shaped.withColumns({"n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(w) - 1}).withColumn("spline", F.coalesce("spline", F.lit(False)))
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    p = p.withColumn("sharp", end | F.when(F.col("spline"), F.col("type") == "angle").otherwise(F.col("type") != "curve"))
    p = p.withColumns({f"{c}{k}": f(F.col(c), k).over(w) for c in ("x", "y") for k, f in ((0, lambda v, _: F.lag(v)), (1, lambda v, _: F.lead(v)), (2, lambda v, k: F.lead(v, k)))} | {"next_sharp": F.lead("sharp").over(w)})
    plain = (F.col("n") < 2) | (F.col("n") != F.col("size"))
    smooth = ~plain & F.col("spline") & (F.col("i") < F.col("n") - 1)
    corner = ~plain & ~F.col("spline") & ~F.col("sharp")
    some = F.when(smooth, F.sequence(F.when(F.col("i") == 0, 0).otherwise(1), F.lit(steps))).when(corner, F.sequence(F.lit(0), F.lit(steps))).when(~plain & F.col("spline"), F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    k = p.withColumn("k", F.explode(some)).withColumn("t", F.col("k") / F.lit(float(steps)))
    before, after = (F.hypot(F.col(f"x{e}") - F.col("x"), F.col(f"y{e}") - F.col("y")) for e in (0, 1))
    pull = F.least(before, after) * reach
    share = lambda d: F.when(d > 1e-6, pull / d).otherwise(0.0)

    def at(c: str) -> Column:
        v, t, a, b, e = F.col(c), F.col("t"), F.col(f"{c}0"), F.col(f"{c}1"), F.col(f"{c}2")
        c1 = v + (b - F.when(F.col("sharp"), v).otherwise(a)) / 6
        c2 = b - (F.when(F.col("next_sharp"), b).otherwise(e) - v) / 6
        into, out = v + (a - v) * share(before), v + (b - v) * share(after)
        along = (1 - t) ** 3 * v + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * b
        return F.when(smooth, along).when(corner, (1 - t) ** 2 * into + 2 * (1 - t) * t * v + t**2 * out).otherwise(v).alias(c)

    return k.select("way_id", (F.row_number().over(Window.partitionBy("way_id").orderBy("i", "k")) - 1).alias("seq"), at("x"), at("y"))
