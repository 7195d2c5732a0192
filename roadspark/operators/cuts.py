"""Cutting ways at points: splits, shaping points, shared nodes where roads cross, signals in mid-road."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.tags import distance, tag
from roadspark.operators.edits import remap_nodes
from roadspark.operators.graph import weak_components
from roadspark.operators.mapbuild import located, pieces_of, way_nodes
from roadspark.operators.spatial import segment_crossings, segments
from roadspark.plans.store import stored

EPS = 1e-4


def _whole(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways all of whose nodes are known."""
    known = located(ways, nodes).groupBy("way_id").agg(F.count(F.lit(1)).alias("known"))
    return ways.join(known, "way_id").where("known = size(nodes) and known >= 2").select(*ways.columns)


def _along(df: DataFrame) -> DataFrame:
    """Adds u, px, py, d: the point (x, y) brought onto its segment (ax, ay)-(bx, by).

    u divides by the square of the rounded length: the SQL does, and whether a foot at the far end counts as short of it hangs on that bit.
    """
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    l2 = length * length
    u = F.when(l2 > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * ex + (F.col("y") - F.col("ay")) * ey) / l2))).otherwise(0.0)
    on = df.withColumn("u", u).withColumns({"px": F.col("ax") + F.col("u") * ex, "py": F.col("ay") + F.col("u") * ey})
    # from the segment's own beginning: far from the origin, px and py have lost the digits that tell two segments apart
    return on.withColumn("d", distance(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("u") * ex, F.col("u") * ey))


def place_on_ways(points: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """point_id, way_id, x, y, ax, ay, bx, by, seq, u, px, py: the nearest segment of each point's own way (ties: the first).

    points: point_id, way_id, x, y. A point meets the segments of one way; those of ways with unknown nodes go. Points are dealt
    over all shuffle partitions, which Spark would merge into few by the size of what comes before the join.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _along(points.select("point_id", "way_id", "x", "y").repartition(parts, "way_id").join(segments(_whole(ways, nodes), nodes), "way_id"))
    kept = ("ax", "ay", "bx", "by", "u", "px", "py")
    best = near.groupBy("point_id", "way_id", "x", "y").agg(F.min(F.struct(F.round("d", 9).alias("near"), "seq", *kept)).alias("b"))
    return best.select("point_id", "way_id", "x", "y", "b.seq", *(f"b.{c}" for c in kept))


def _at_nodes(placed: DataFrame, ways: DataFrame) -> DataFrame:
    """Adds at (place along the way, in segments), found (the node there, if any) and is_end."""
    low, high = F.col("u") <= EPS, F.col("u") >= 1 - EPS
    at = F.when(low, F.col("seq").cast("double")).when(high, F.col("seq") + 1.0).otherwise(F.col("seq") + F.col("u"))
    found = F.when(low, F.get("nodes", F.col("seq"))).when(high, F.get("nodes", F.col("seq") + 1))
    on = placed.join(ways.select("way_id", "nodes"), "way_id").withColumns({"at": at, "found": found})
    return on.withColumn("is_end", F.coalesce((F.col("found") == F.get("nodes", F.lit(0))) | (F.col("found") == F.element_at("nodes", -1)), F.lit(False))).drop("nodes")


def _cut(ways: DataFrame, marks: DataFrame, split: bool) -> DataFrame:
    """The ways with the marks' new nodes, cut at each mark if split. marks: way_id, at, node_id, found; one for each place."""
    touched = ways.join(marks.select("way_id").distinct(), "way_id", "left_semi")
    old = marks.where("found is not null").select("way_id", F.col("at").alias("seq"), F.lit(int(split)).alias("hit"))
    chain = way_nodes(touched).withColumn("seq", F.col("seq").cast("double")).join(old, ["way_id", "seq"], "left").select("way_id", "seq", "node_id", F.coalesce("hit", F.lit(0)).alias("cut"))
    new = marks.where("found is null").select("way_id", F.col("at").alias("seq"), "node_id", F.lit(int(split)).alias("cut"))
    made = pieces_of(chain.unionByName(new), touched, "_c").drop("cuts")
    rest = ways.join(touched.select("way_id"), "way_id", "left_anti").select("way_id", "ord", F.lit(0).cast("long").alias("part"), "tags", "nodes")
    return made.unionByName(rest)


def split_ways_at_points(ways: DataFrame, nodes: DataFrame, points: DataFrame, split: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, new nodes, cuts): each point's nearest place on its way becomes a node where the way is cut.

    points: point_id, way_id, x, y. A place within EPS of a node is that node; at a way's end, and within EPS of an earlier
    point's place, there is no cut. Without split the way stays whole and only gets the new nodes: places at nodes go.
    cuts: point_id, way_id, node_id, before_way_id, after_way_id, x, y, the segment's ax, ay, bx, by, and place (in segments).
    """
    placed = _at_nodes(place_on_ways(points, ways, nodes), ways)
    usable = placed.where("not is_end") if split else placed.where("found is null")
    w = Window.partitionBy("way_id").orderBy("at", "point_id")
    apart = usable.withColumn("gap", F.col("at") - F.lag("at").over(w)).where(F.col("gap").isNull() | (F.col("gap") > EPS))
    named = stored(apart.withColumn("node_id", F.coalesce("found", F.concat(F.lit("c_"), F.col("point_id").cast("string")))), "cuts")
    name = lambda k: F.when(k == 0, F.col("way_id")).otherwise(F.concat("way_id", F.lit("_c"), k.cast("string")))
    k = F.row_number().over(w)
    cuts = named.withColumn("k", k if split else F.lit(1)).select("point_id", "way_id", "node_id", name(F.col("k") - 1).alias("before_way_id"), (name(F.col("k")) if split else F.col("way_id")).alias("after_way_id"), "x", "y", "ax", "ay", "bx", "by", F.col("at").alias("place"))
    fresh = named.where("found is null").select("node_id", F.col("px").alias("x"), F.col("py").alias("y"))
    return _cut(ways, named.select("way_id", "at", "node_id", "found"), split), fresh, cuts


def connect_crossings(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) with a shared node wherever two ways cross, both cut there.

    A node of either way within EPS is used; where each way has one of its own, they are merged into the least. Ways aren't
    cut at their own ends. New nodes are named by their place in centimetres, so that more ways through it share one.
    """
    whole = _whole(ways, nodes)
    hits = segment_crossings(whole, nodes).withColumn("spot", F.concat_ws("_", F.lit("x"), F.round(F.col("x") * 100).cast("long"), F.round(F.col("y") * 100).cast("long")))
    hits = stored(hits, "hits")
    side = lambda a: hits.select("spot", "way_a", "way_b", "x", "y", F.col(f"way_{a}").alias("way_id"), F.col(f"seq_{a}").alias("seq"), F.lit(a).alias("side"))
    placed = _at_nodes(_along(side("a").unionByName(side("b")).join(segments(whole, nodes), ["way_id", "seq"])), whole)
    # a crossing at a node touches up to four pairs of segments
    one = stored(placed.groupBy("spot", "way_a", "way_b", "side", "way_id").agg(F.min(F.struct("at", "found", "is_end", "x", "y")).alias("p")).select("spot", "way_a", "way_b", "side", "way_id", "p.*"), "sides")
    per = one.groupBy("spot").agg(F.min("found").alias("node"), F.min("x").alias("sx"), F.min("y").alias("sy"))
    named = stored(one.join(per, "spot").withColumn("node_id", F.coalesce("node", "spot")), "crossings")
    fresh = named.where("node is null").groupBy("node_id").agg(F.min("sx").alias("x"), F.min("sy").alias("y"))
    merged = named.where("found is not null and found <> node_id").select(F.col("found").alias("src"), F.col("node_id").alias("dst")).distinct()
    w = Window.partitionBy("way_id").orderBy("at", "node_id")
    marks = named.where("not is_end").select("way_id", "at", "node_id", "found").distinct().withColumn("gap", F.col("at") - F.lag("at").over(w)).where(F.col("gap").isNull() | (F.col("gap") > EPS))
    made = _cut(ways, marks.drop("gap"), True)
    extra = [c for c in nodes.columns if c not in ("node_id", "x", "y")]
    kind = {f.name: f.dataType for f in nodes.schema.fields}
    all_nodes = nodes.unionByName(fresh.select("node_id", "x", "y", *((F.create_map().cast(kind[c]) if c == "tags" else F.lit(None).cast(kind[c])).alias(c) for c in extra)))
    if merged.isEmpty():
        return made, all_nodes
    least = weak_components(merged).where("node_id <> component").select(F.col("node_id").alias("from_id"), F.col("component").alias("into_id"))
    moved_nodes, moved_ways = remap_nodes(all_nodes, made, least)
    return moved_ways, moved_nodes


def midblock_signals(ways: DataFrame, nodes: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, new nodes, signals): a one-phase signal in mid-road for each point, on the side of the road that it lies on.

    The way is cut at the point. On one-way roads the half that traffic comes from is lit; else the half before, if the
    point lies to the left of the way's direction, or the half after. signals: point_id, node_id, all_red_sec, lit_way_id,
    green_sec, yellow_sec.
    """
    made, fresh, cuts = split_ways_at_points(ways, nodes, points)
    one = cuts.join(ways.select("way_id", F.lower(F.trim(F.coalesce(tag("oneway"), F.lit("")))).alias("one")), "way_id")
    cross = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    lit = F.when(F.col("one") == "yes", F.col("before_way_id")).when(F.col("one") == "-1", F.col("after_way_id")).when(cross > 0, F.col("before_way_id")).otherwise(F.col("after_way_id"))
    return made, fresh, one.select("point_id", "node_id", F.lit(2.0).alias("all_red_sec"), lit.alias("lit_way_id"), F.lit(25.0).alias("green_sec"), F.lit(3.0).alias("yellow_sec"))
