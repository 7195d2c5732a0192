
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import backward, distance, forward, lookup, speed_kmh, tag


def map_bounds(osm_nodes: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """minlat, minlon, maxlat, maxlon, origin_lat, origin_lon: the file's own bounds if given, else the nodes' extent."""
    box = osm_nodes.agg(F.min("lat").alias("minlat"), F.min("lon").alias("minlon"), F.max("lat").alias("maxlat"), F.max("lon").alias("maxlon"))
    if bounds is not None:
        own = bounds.limit(1).select(*(F.col(c).alias(f"b_{c}") for c in box.columns))
        box = box.join(F.broadcast(own), F.lit(True), "left").select(*(F.coalesce(f"b_{c}", c).alias(c) for c in box.columns))
    return box.withColumns({"origin_lat": (F.col("minlat") + F.col("maxlat")) / 2, "origin_lon": (F.col("minlon") + F.col("maxlon")) / 2})


def project_xy(df: DataFrame, origin_lat: float, origin_lon: float) -> DataFrame:
    """Adds x, y in metres (equirectangular about the origin) from lat, lon."""
    x = F.radians(F.col("lon") - origin_lon) * C.EARTH_RADIUS_M * F.cos(F.radians(F.lit(origin_lat)))
    return df.withColumns({"x": x, "y": F.radians(F.col("lat") - origin_lat) * C.EARTH_RADIUS_M})


def project_inverse(df: DataFrame, origin_lat: float, origin_lon: float) -> DataFrame:
    """Adds lat, lon from x, y."""
    lon = F.lit(origin_lon) + F.degrees(F.col("x") / (C.EARTH_RADIUS_M * F.cos(F.radians(F.lit(origin_lat)))))
    return df.withColumns({"lat": F.lit(origin_lat) + F.degrees(F.col("y") / C.EARTH_RADIUS_M), "lon": lon})


def way_nodes(ways: DataFrame) -> DataFrame:
    """way_id, seq, node_id."""
    return ways.select("way_id", F.posexplode("nodes").alias("seq", "node_id"))


def dangling_refs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seq, node_id of references to unknown nodes."""
    return way_nodes(ways).join(nodes.select("node_id"), "node_id", "left_anti").select("way_id", "seq", "node_id")


def routable_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways that traffic may use: class allowed, access not 'no', two nodes or more, all of them known."""
    kind = F.coalesce(tag("highway"), F.lit(""))
    usable = ways.where((kind != "") & ~kind.isin(*C.EXCLUDED_CLASSES) & (F.coalesce(tag("access"), F.lit("")) != "no") & (F.size("nodes") >= 2) & (speed_kmh() / 3.6 >= 0.1))
    return usable.join(dangling_refs(usable, nodes).select("way_id").distinct(), "way_id", "left_anti")


def way_speed(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", speed_kmh().alias("speed_kmh"), (speed_kmh() / 3.6).alias("speed_mps"))


def way_direction(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", forward().alias("forward"), backward().alias("backward"))


def layer_column():
    return F.coalesce(tag("layer").try_cast("int"), F.when(F.lower(tag("bridge")) == "yes", 1).otherwise(0))


def way_layer(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", layer_column().alias("layer"))


def lane_policy(ways: DataFrame) -> DataFrame:
    """ways with the lanes tag set by class; residential only where it has none."""
    kind, one = tag("highway"), F.lower(F.trim(F.coalesce(tag("oneway"), F.lit("")))) == "yes"
    lanes = F.when(kind == "primary", "3").when(kind == "secondary", F.when(one, "2").otherwise("4")).when((kind == "tertiary") & ~one, "2").when((kind == "residential") & tag("lanes").isNull(), "2")
    rest = F.map_filter("tags", lambda k, _: k != "lanes")
    return ways.withColumn("tags", F.when(lanes.isNull(), F.col("tags")).otherwise(F.map_concat(rest, F.create_map(F.lit("lanes"), lanes))))


def road_defaults(ways: DataFrame, maxspeed: str = "60", avg_min_speed: str = "20", avg_max_speed: str = "60", lanes: str = "1", lane_width: str = "3.2") -> DataFrame:
    """ways with missing tags filled in: one lane on one-way roads, a divider where a two-way road has two lanes or more."""
    one = F.lower(F.trim(F.coalesce(tag("oneway"), F.lit("")))) == "yes"
    with_lanes = F.coalesce(tag("lanes"), F.when(one, F.lit("1")).otherwise(F.lit(lanes)))
    wide = F.coalesce(F.regexp_extract(with_lanes, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(2))
    values = {"maxspeed": F.lit(maxspeed), "avg_min_speed": F.lit(avg_min_speed), "avg_max_speed": F.lit(avg_max_speed), "lanes": with_lanes, "lane_width": F.lit(lane_width), "divider": F.when(one | (wide < 2), "no").otherwise("yes")}
    own = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    return ways.withColumn("tags", F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys("tags"), k)), F.col("tags")))


def located(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seq, node_id, x, y of known nodes. By sorted merge: by the size of its compressed file, a large table of nodes would go to the driver."""
    return way_nodes(ways).hint("merge").join(nodes.select("node_id", "x", "y"), "node_id").select("way_id", "seq", "node_id", "x", "y")


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, length_m along the nodes, width_m = lanes x lane width."""
    w = Window.partitionBy("way_id").orderBy("seq")
    step = located(ways, nodes).withColumn("d", distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)))
    lanes, wide = F.coalesce(tag("lanes").try_cast("double"), F.lit(2.0)), F.coalesce(tag("lane_width").try_cast("double"), F.lit(C.LANE_WIDTH_M))
    return step.groupBy("way_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m")).join(ways.select("way_id", (lanes * wide).alias("width_m")), "way_id")


def vehicle_ways(ways: DataFrame) -> DataFrame:
    return ways.where(tag("highway").isin(*C.VEHICLE_CLASSES))


def node_touch_count(ways: DataFrame) -> DataFrame:
    """node_id, touches: distinct vehicle ways through each node."""
    return way_nodes(vehicle_ways(ways)).select("way_id", "node_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("touches"))


def pieces_of(flagged: DataFrame, ways: DataFrame, mark: str) -> DataFrame:
    """way_id, ord, part, tags, nodes, cuts: the ways of flagged (way_id, seq, node_id, cut) cut after each position with cut 1.

    The node of a cut ends one piece and begins the next; the first piece keeps its id, later ones get mark and a number.
    """
    before = Window.partitionBy("way_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = flagged.withColumn("piece", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    both = pieces.withColumn("piece", F.explode(F.when(F.col("cut") == 1, F.array(F.col("piece"), F.col("piece") + 1)).otherwise(F.array("piece"))))
    made = both.groupBy("way_id", "piece").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("s"), F.sum("cut").alias("cuts")).where("size(s) >= 2")
    return made.join(ways.select("way_id", "ord", "tags"), "way_id").select(
        F.when(F.col("piece") == 0, F.col("way_id")).otherwise(F.concat("way_id", F.lit(mark), "piece")).alias("way_id"), "ord", F.col("piece").cast("long").alias("part"), "tags", F.transform("s", lambda e: e["node_id"]).alias("nodes"), "cuts"
    )


def split_ways(ways: DataFrame) -> DataFrame:
    """ways cut at inner nodes that two or more vehicle ways touch: the first piece keeps its id, later ones get _s<n>.

    A loop's first and last positions aren't inner ones. Other ways pass unchanged.
    """
    vehicle = vehicle_ways(ways)
    flagged = way_nodes(vehicle).join(node_touch_count(ways), "node_id").join(vehicle.select("way_id", F.size("nodes").alias("n")), "way_id")
    cut = ((F.col("touches") >= 2) & (F.col("seq") > 0) & (F.col("seq") < F.col("n") - 1)).cast("int")
    kept = pieces_of(flagged.withColumn("cut", cut), vehicle, "_s").drop("cuts")
    others = ways.join(vehicle.select("way_id"), "way_id", "left_anti").select("way_id", "ord", F.lit(0).cast("long").alias("part"), "tags", "nodes")
    return kept.unionByName(others)


def way_ends(ways: DataFrame) -> DataFrame:
    """way_id, node_id, layer, last: both ends of vehicle ways that aren't closed loops."""
    open_ways = vehicle_ways(ways).where((F.size("nodes") >= 2) & (F.get("nodes", F.lit(0)) != F.element_at("nodes", -1))).withColumn("layer", layer_column())
    ends = F.array(F.struct(F.get("nodes", F.lit(0)).alias("node_id"), F.lit(False).alias("last")), F.struct(F.element_at("nodes", -1).alias("node_id"), F.lit(True).alias("last")))
    return open_ways.select("way_id", "layer", F.explode(ends).alias("e")).select("way_id", "e.node_id", "layer", "e.last")


def junction_endpoints(ways: DataFrame) -> DataFrame:
    """node_id, layer, ends, is_junction (two ends or more)."""
    return way_ends(ways).groupBy("node_id", "layer").agg(F.count(F.lit(1)).alias("ends")).withColumn("is_junction", F.col("ends") >= 2)


def trim_ways(ways: DataFrame, nodes: DataFrame, trim_m: float = C.TRIM_M) -> DataFrame:
    """way_id, seq, x, y, node_id (null where a new end was cut), trimmed_len: vehicle ways pulled back from their junctions.

    Each end at a junction is cut trim_m along the way; ways no longer than all their cuts stay as they are.
    """
    junction = junction_endpoints(ways).where("is_junction").select("node_id", "layer")
    ends = way_ends(ways).join(junction, ["node_id", "layer"], "left_semi")
    cuts = ends.groupBy("way_id").agg(F.max(F.when(~F.col("last"), trim_m).otherwise(0.0)).alias("head"), F.max(F.when(F.col("last"), trim_m).otherwise(0.0)).alias("tail"))
    w = Window.partitionBy("way_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = located(vehicle_ways(ways), nodes).withColumn("d", F.coalesce(distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0)))
    path = path.withColumn("at", F.sum("d").over(upto)).withColumn("total", F.sum("d").over(Window.partitionBy("way_id"))).join(cuts, "way_id", "left").na.fill(0.0, ["head", "tail"])
    skip = F.col("total") <= F.col("head") + F.col("tail")
    path = path.withColumns({"head": F.when(skip, 0.0).otherwise(F.col("head")), "tail": F.when(skip, 0.0).otherwise(F.col("tail"))}).withColumn("stop", F.col("total") - F.col("tail"))
    after = {c: F.lead(c).over(w) for c in ("x", "y", "at")}
    path = path.withColumns({f"n_{c}": v for c, v in after.items()})

    def point(where):
        share = (where - F.col("at")) / (F.col("n_at") - F.col("at"))
        return F.struct(where.alias("at"), (F.col("x") + share * (F.col("n_x") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("n_y") - F.col("y"))).alias("y"), F.lit(None).cast("string").alias("node_id"))

    own = F.when((F.col("at") >= F.col("head")) & (F.col("at") <= F.col("stop")), F.struct("at", "x", "y", "node_id"))
    first = F.when((F.col("head") > 0) & (F.col("at") < F.col("head")) & (F.col("n_at") > F.col("head")), point(F.col("head")))
    last = F.when((F.col("tail") > 0) & (F.col("at") < F.col("stop")) & (F.col("n_at") > F.col("stop")), point(F.col("stop")))
    cut = path.select("way_id", "seq", (F.col("stop") - F.col("head")).alias("trimmed_len"), F.explode(F.filter(F.array(own, first, last), lambda p: p.isNotNull())).alias("p"))
    order = Window.partitionBy("way_id").orderBy("p.at", "seq")
    return cut.select("way_id", (F.row_number().over(order) - 1).alias("seq"), "p.x", "p.y", "p.node_id", "trimmed_len")


def prune_nodes(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways): dangling references and ways left with one node go, then nodes that are neither used nor interesting."""
    known = way_nodes(ways).join(nodes.select("node_id"), "node_id", "left_semi")
    kept = known.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("s")).where("size(s) >= 2")
    out = ways.drop("nodes").join(kept, "way_id").withColumn("nodes", F.transform("s", lambda e: e["node_id"])).drop("s")
    used = way_nodes(out).select("node_id").distinct().withColumn("used", F.lit(True))
    wanted = F.coalesce("used", F.lit(False)) | F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, C.INTERESTING_TAGS)))
    return nodes.join(used, "node_id", "left").where(wanted).withColumns({"x": F.bround("x", 2), "y": F.bround("y", 2)}).drop("used"), out


def polygon_measures(buildings: DataFrame) -> DataFrame:
    """building_id, area_m2, cx, cy, mean_x, mean_y, min_x, min_y, max_x, max_y."""
    p = F.col("polygon")
    turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    cross = F.transform(F.arrays_zip(p.alias("a"), turned.alias("b")), lambda e: F.struct((e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).alias("c"), (e["a"]["x"] + e["b"]["x"]).alias("sx"), (e["a"]["y"] + e["b"]["y"]).alias("sy")))
    total = lambda f: F.aggregate("cross", F.lit(0.0), lambda s, e: s + f(e))
    mean = lambda c: F.aggregate(p[c], F.lit(0.0), lambda s, v: s + v) / F.size(p)
    d = buildings.withColumn("cross", cross).withColumns({"signed": total(lambda e: e["c"]) / 2, "mx": total(lambda e: e["sx"] * e["c"]), "my": total(lambda e: e["sy"] * e["c"])})
    flat = F.abs("signed") < 1e-6
    return d.select(
        "building_id", F.abs("signed").alias("area_m2"),
        F.when(flat, mean("x")).otherwise(F.col("mx") / (6 * F.col("signed"))).alias("cx"), F.when(flat, mean("y")).otherwise(F.col("my") / (6 * F.col("signed"))).alias("cy"),
        mean("x").alias("mean_x"), mean("y").alias("mean_y"),
        F.array_min(p["x"]).alias("min_x"), F.array_min(p["y"]).alias("min_y"), F.array_max(p["x"]).alias("max_x"), F.array_max(p["y"]).alias("max_y"),
    )


def orphan_cleanup(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes kept, removed[removed]): nodes without ways and without tags go."""
    used = way_nodes(ways).select("node_id").distinct().withColumn("used", F.lit(1))
    marked = nodes.join(used, "node_id", "left").withColumn("gone", F.col("used").isNull() & (F.size("tags") == 0))
    return marked.where("not gone").drop("used", "gone"), marked.agg(F.coalesce(F.sum(F.col("gone").cast("long")), F.lit(0)).alias("removed"))


def add_only_merge(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, counts[added, skipped]): incoming rows whose key is absent are appended."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    counts = incoming.join(existing.select(key).distinct().withColumn("there", F.lit(1)), key, "left").agg(F.count_if(F.col("there").isNull()).alias("added"), F.count_if(F.col("there").isNotNull()).alias("skipped"))
    return existing.unionByName(fresh), counts


def bulk_tags(table: DataFrame, selection: DataFrame, id_col: str, key: str, value: str) -> DataFrame:
    """table with one tag set on the selected ids."""
    chosen = table.join(selection.select(id_col).distinct().withColumn("__on", F.lit(True)), id_col, "left")
    put = F.map_concat(F.map_filter("tags", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))
    return chosen.withColumn("tags", F.when(F.col("__on"), put).otherwise(F.col("tags"))).select(*table.columns)


def road_view(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(road_ways[way_id, highway, nodes], road_nodes[node_id, x, y]): classes allowed, unknown nodes dropped, two left."""
    kind = F.coalesce(tag("highway"), F.lit(""))
    allowed = ways.where((kind != "") & ~kind.isin(*C.EXCLUDED_CLASSES))
    known = way_nodes(allowed).join(nodes.select("node_id"), "node_id", "left_semi")
    kept = known.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("s")).where("size(s) >= 2")
    out = allowed.select("way_id", kind.alias("highway")).join(kept, "way_id").select("way_id", "highway", F.transform("s", lambda e: e["node_id"]).alias("nodes"))
    return out, nodes.join(way_nodes(out).select("node_id").distinct(), "node_id", "left_semi").select("node_id", "x", "y")


def node_index(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """node_id, degree, group_id, primary_node_id, group_size, group_cx, group_cy."""
    degree = way_nodes(ways).groupBy("node_id").agg(F.count_distinct("way_id").alias("degree"))
    placed = nodes.withColumn("group_id", tag("join_group"))
    primary = F.min_by("node_id", F.struct(F.col("signal").isNull().cast("int"), "node_id")) if "signal" in nodes.columns else F.min("node_id")
    groups = placed.where("group_id is not null").groupBy("group_id").agg(primary.alias("primary_node_id"), F.count(F.lit(1)).alias("group_size"), F.avg("x").alias("group_cx"), F.avg("y").alias("group_cy"))
    return placed.join(degree, "node_id", "left").join(groups, "group_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), "group_id", "primary_node_id", "group_size", "group_cx", "group_cy")


def class_speed_rank(kind):
    return F.coalesce(lookup(C.ROAD_RANK, kind), F.lit(0))
