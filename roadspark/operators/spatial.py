"""Spatial joins over grid cells: no cross joins, radius bounded by the cell size or found by growing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import distance, lookup, tag
from roadspark.operators.mapbuild import located, polygon_measures, way_nodes
from roadspark.plans.store import stored


def _cell(c, size: float):
    return F.floor(F.col(c) / size)


def with_cell(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"cx": _cell(x, size), "cy": _cell(y, size)})


def with_near_cells(df: DataFrame, size: float, x: str = "x", y: str = "y", rings: int = 1) -> DataFrame:
    """A row for each cell within `rings` of the point's own."""
    d = F.sequence(F.lit(-rings), F.lit(rings))
    return df.withColumn("dx", F.explode(d)).withColumn("dy", F.explode(d)).withColumns({"cx": _cell(x, size) + F.col("dx"), "cy": _cell(y, size) + F.col("dy")}).drop("dx", "dy")


def meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a and b joined by sorted merge. Spark's size estimates leave out the rows that explode makes, so it would take a table of
    many times its size for a small one and gather it in the driver to broadcast it."""
    return a.hint("merge").join(b, on)


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seq, ax, ay, bx, by: each stretch between neighbouring nodes."""
    w = Window.partitionBy("way_id").orderBy("seq")
    return located(ways, nodes).select("way_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")


def segment_cells(segs: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """A row for each cell that the segment's box, widened by margin, touches."""
    low = lambda a, b: F.floor((F.least(a, b) - margin) / size)
    high = lambda a, b: F.floor((F.greatest(a, b) + margin) / size)
    return segs.withColumn("cx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float = 100.0) -> DataFrame:
    """id, node_id, dist_m: the nearest node to each point, however far (ties: the smaller id).

    A round looks at the cells around each point; a node found within one cell's width is final, other points go on with
    doubled cells. Each round is written, so none is computed again. Points or nodes without finite coordinates count for
    nothing; without nodes there are no rows. Points are told apart by id.
    """
    finite = lambda x, y: f"abs({x}) < 1e300 and abs({y}) < 1e300"
    todo = points.select("id", "x", "y").where(finite("x", "y"))
    spots = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")).where(finite("nx", "ny"))
    any_node, done, size = not spots.isEmpty(), None, cell
    while True:
        near = meet(with_near_cells(todo, size), with_cell(spots, size, "nx", "ny"), ["cx", "cy"]).withColumn("d2", (F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)
        best = near.groupBy("id").agg(F.min(F.struct("d2", "node_id")).alias("b")).select("id", "b.node_id", F.sqrt("b.d2").alias("dist_m")).where(F.col("dist_m") <= size)
        best = stored(best, "nearest")
        done = best if done is None else done.unionByName(best)
        todo = stored(todo.join(best, todo["id"].eqNullSafe(best["id"]), "left_anti"), "far")
        if not any_node or todo.isEmpty():
            return done
        size *= 2


def _segment_distance():
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    l2 = dx * dx + dy * dy
    share = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / l2))).otherwise(0.0)
    return share, distance(F.col("x"), F.col("y"), F.col("ax") + share * dx, F.col("ay") + share * dy)


def nearest_way(points: DataFrame, ways: DataFrame, nodes: DataFrame, tol_m: float) -> DataFrame:
    """id, way_id, dist_m: the nearest way within tol_m of each point (ties, to a millionth of a metre: the smaller id)."""
    cells = segment_cells(segments(ways, nodes), 4 * tol_m, tol_m)
    near = meet(cells, with_cell(points.select("id", "x", "y"), 4 * tol_m), ["cx", "cy"]).withColumn("d", _segment_distance()[1]).where(F.col("d") <= tol_m)
    return near.groupBy("id").agg(F.min(F.struct(F.round("d", 6).alias("near"), "way_id", "d")).alias("b")).select("id", "b.way_id", F.col("b.d").alias("dist_m"))


def nearest_amenity(points: DataFrame, amenities: DataFrame, tol_m: float) -> DataFrame:
    """id, amenity_id, dist_m: the nearest amenity within tol_m (ties: the smaller id)."""
    spots = with_cell(amenities.select("amenity_id", F.col("x").alias("nx"), F.col("y").alias("ny")), tol_m, "nx", "ny")
    near = meet(with_near_cells(points.select("id", "x", "y"), tol_m), spots, ["cx", "cy"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).where(F.col("d") <= tol_m)
    return near.groupBy("id").agg(F.min(F.struct("d", "amenity_id")).alias("b")).select("id", "b.amenity_id", F.col("b.d").alias("dist_m"))


ROWS_A_TASK = 200_000


def point_in_building(points: DataFrame, buildings: DataFrame, cell: float = 60.0) -> DataFrame:
    """id, building_id: the first footprint (by order) that holds the point, by the even-odd rule.

    Cells are dealt to as many tasks as keep some ROWS_A_TASK footprints and points each, as what a task sorts would grow with the input.
    """
    box = buildings.select("building_id", "ord", "polygon").withColumns({"lx": F.array_min("polygon.x"), "hx": F.array_max("polygon.x"), "ly": F.array_min("polygon.y"), "hy": F.array_max("polygon.y")})
    cells = box.withColumn("cx", F.explode(F.sequence(F.floor(F.col("lx") / cell), F.floor(F.col("hx") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("ly") / cell), F.floor(F.col("hy") / cell))))
    spots = with_cell(points.select("id", "x", "y"), cell)
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(cells.select("cx").count() + spots.count()) // ROWS_A_TASK))
    near = meet(cells.repartition(tasks, "cx", "cy"), spots.repartition(tasks, "cx", "cy"), ["cx", "cy"]).where("x between lx and hx and y between ly and hy")
    n = F.size("polygon")

    def crosses(i):
        a, b = F.get("polygon", i), F.get("polygon", (i + n - 1) % n)
        return ((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    inside = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.coalesce(crosses(i), F.lit(False)).cast("int")) % 2 == 1
    return near.where(inside).groupBy("id").agg(F.min(F.struct("ord", "building_id")).alias("b")).select("id", "b.building_id")


def bbox_select(nodes: DataFrame, ways: DataFrame, buildings: DataFrame, amenities: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """kind, id of what lies in a rectangle: nodes and amenities, ways with a node in it, footprints with a corner in it."""
    within = F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    corner = F.exists("polygon", lambda p: p["x"].between(min(x0, x1), max(x0, x1)) & p["y"].between(min(y0, y1), max(y0, y1)))
    of = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return of("node", nodes.where(within), "node_id").unionByName(of("way", located(ways, nodes).where(within).select("way_id").distinct(), "way_id")).unionByName(of("building", buildings.where(corner), "building_id")).unionByName(of("amenity", amenities.where(within), "amenity_id"))


def segment_crossings(ways: DataFrame, nodes: DataFrame, cell: float = 120.0) -> DataFrame:
    """way_a, seq_a, way_b, seq_b, x, y: where segments of different ways cross or touch."""
    cells = segment_cells(segments(ways, nodes), cell)
    a = cells.select("cx", "cy", *(F.col(c).alias(f"a_{c}") for c in ("way_id", "seq", "ax", "ay", "bx", "by")))
    b = cells.select("cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("way_id", "seq", "ax", "ay", "bx", "by")))
    c = F.col
    rx, ry, sx, sy = c("a_bx") - c("a_ax"), c("a_by") - c("a_ay"), c("b_bx") - c("b_ax"), c("b_by") - c("b_ay")
    turn = rx * sy - ry * sx
    t = ((c("b_ax") - c("a_ax")) * sy - (c("b_ay") - c("a_ay")) * sx) / F.when(turn != 0, turn)
    u = ((c("b_ax") - c("a_ax")) * ry - (c("b_ay") - c("a_ay")) * rx) / F.when(turn != 0, turn)
    pairs = meet(a, b, ["cx", "cy"]).where("a_way_id < b_way_id").withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1")
    return pairs.select(c("a_way_id").alias("way_a"), c("a_seq").alias("seq_a"), c("b_way_id").alias("way_b"), c("b_seq").alias("seq_b"), (c("a_ax") + c("t") * rx).alias("x"), (c("a_ay") + c("t") * ry).alias("y")).dropDuplicates(["way_a", "seq_a", "way_b", "seq_b"])


def nearest_major_road(points: DataFrame, nodes: DataFrame, ways: DataFrame, radius_m: float = C.APARTMENTS_M, exact: bool = False) -> DataFrame:
    """id, tier, dist_m: the nearest node of a major road, closer than radius_m, found ring by ring of 40 m cells.

    Rings 0 and 1 count together and the first ring with a hit ends the search, so a nearer node one ring further out is
    passed over; exact=True finds the nearest within the radius. Ties go to the smaller tier name.
    """
    size = C.RETAG_CELL_M
    major = meet(way_nodes(ways.where(tag("highway").isin(*C.ROAD_TIER))), ways.select("way_id", lookup(C.ROAD_TIER, tag("highway")).alias("tier")), ["way_id"]).select("node_id", "tier").distinct()
    # cells as wide as the radius tell who meets whom, nine for each point; rings are counted in the small ones
    spots = with_cell(meet(major, nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), ["node_id"]), radius_m, "nx", "ny")
    near = meet(with_near_cells(points.select("id", "x", "y"), radius_m), spots, ["cx", "cy"])
    ring = F.greatest(F.lit(1), *(F.abs(_cell(f"n{c}", size) - _cell(c, size)) for c in ("x", "y")))
    near = near.withColumns({"d": distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")), "ring": F.lit(1) if exact else ring}).where(F.col("d") < radius_m)
    return near.groupBy("id").agg(F.min(F.struct("ring", "d", "tier")).alias("b")).select("id", "b.tier", F.col("b.d").alias("dist_m"))


def amenity_by_building(amenities: DataFrame) -> DataFrame:
    """building_id, amenity_id, amenity: the last amenity linked to each building."""
    last = amenities.where("building_id is not null").groupBy("building_id").agg(F.max_by(F.struct("amenity_id", tag("amenity").alias("amenity")), "ord").alias("a"))
    return last.select("building_id", "a.amenity_id", "a.amenity")


def retag_buildings(buildings: DataFrame, amenities: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """building_id, building: what a footprint still tagged building=yes becomes."""
    plain = buildings.where(tag("building") == "yes")
    measures = polygon_measures(plain).select("building_id", "area_m2", F.col("cx").alias("x"), F.col("cy").alias("y"))
    road = nearest_major_road(measures.select(F.col("building_id").alias("id"), "x", "y"), nodes, ways).withColumnRenamed("id", "building_id")
    # by sorted merge, as in meet: footprints are built from few columns, so Spark takes their tables for small ones
    all_ = meet(plain, measures, ["building_id"]).join(amenity_by_building(amenities).hint("merge"), "building_id", "left").join(road.hint("merge"), "building_id", "left")
    zone = F.when(F.col("tier").isNull(), "residential").when(F.col("dist_m") > C.COMMERCIAL_M, "apartments").when((F.col("tier") == "trunk") & (F.col("area_m2") >= C.INDUSTRIAL_M2), "industrial").otherwise("commercial")
    kind = (
        F.when(F.col("amenity_id").isNotNull(), F.coalesce(lookup(C.AMENITY_BUILDING, F.col("amenity")), F.lit("commercial")))
        .when(tag("shop").isNotNull(), "retail").when(tag("office").isNotNull(), "office")
        .when(tag("tourism").isNotNull(), F.coalesce(lookup(C.TOURISM_BUILDING, tag("tourism")), F.lit("commercial"))).when(tag("leisure").isNotNull(), "commercial").otherwise(zone)
    )
    return all_.select("building_id", kind.alias("building"))


IDS_A_ROW, PAIRS_A_TASK = 64, 100_000_000


def _lists(states: DataFrame, *spot: str) -> DataFrame:
    """t, spot, part, ids: the ids that share a tick and all columns of spot, IDS_A_ROW at most in a row."""
    at = Window.partitionBy("t", *spot).orderBy("id")
    dealt = states.select("t", "id", *spot).where("t IS NOT NULL AND id IS NOT NULL").withColumn("part", F.floor((F.row_number().over(at) - 1) / IDS_A_ROW))
    return dealt.groupBy("t", *spot, "part").agg(F.collect_list("id").alias("ids"))


def _tasks(near: DataFrame, pairs) -> int:
    """Tasks that keep some PAIRS_A_TASK of the pairs of near each."""
    return min(10_000, max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + int((near.agg(F.sum(pairs)).first()[0] or 0) // PAIRS_A_TASK)))


def close_pairs(states: DataFrame, least_m: float, places: int | None = None) -> DataFrame:
    """t, id_a, id_b, dist_m of vehicles nearer than least_m at the same tick, rounded to so many places. states: t, id, x, y.

    Rows grow with the square of the vehicles in sight. Those at one spot are lists of IDS_A_ROW ids at most, and two lists are
    compared once, so what is left to do for a pair is to write it (a task holds the pairs of two lists at once); cells are dealt to as many tasks as keep some PAIRS_A_TASK pairs each.
    """
    spots = stored(with_cell(_lists(states, "x", "y"), least_m), "spots")
    a = spots.select("t", "cx", "cy", "x", "y", "part", F.col("ids").alias("ids_a"))
    # each pair of lists once: within a cell by place and part, and with four of the eight cells around
    b = spots.select("t", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("part").alias("bpart"), F.col("ids").alias("ids_b"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    b = b.withColumn("d", F.explode(ahead)).withColumns({"cx": F.col("ox") - F.col("d.dx"), "cy": F.col("oy") - F.col("d.dy"), "own": (F.col("d.dx") == 0) & (F.col("d.dy") == 0)}).drop("d", "ox", "oy")
    on = ["t", "cx", "cy"]
    tasks = _tasks(spots.groupBy(*on).agg(F.sum(F.size("ids")).cast("double").alias("n")), F.col("n") * F.col("n"))
    same = F.expr("own AND x = bx AND y = by AND part = bpart")
    once = F.expr("NOT own OR struct(x, y, part) <= struct(bx, by, bpart)")
    dist = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    near = meet(a.repartition(tasks, *on), b.repartition(tasks, *on), on).where(once).withColumns({"dist_m": dist, "same": same}).where(F.col("dist_m") < least_m)
    near = near.select("t", "same", "ids_a", "ids_b", (F.col("dist_m") if places is None else F.round("dist_m", places)).alias("dist_m"))
    both = near.select("t", "same", "dist_m", "ids_b", F.explode("ids_a").alias("i")).select("t", "same", "dist_m", "i", F.explode("ids_b").alias("j"))
    return both.where("CASE WHEN same THEN i < j ELSE i <> j END").select("t", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "dist_m")


def vision_cone(observers: DataFrame, vehicles: DataFrame, half_angle: float, range_m: float, places: int | None = None) -> DataFrame:
    """t, id, other_id, dist_m, bearing, closing_mps: who stands within range and half an angle of an observer's heading (radians).

    observers: t, id, x, y, heading; vehicles: t, id, x, y, heading, speed_mps. closing_mps is the other's speed towards the observer (below
    zero: away from it); vehicles without columns for heading and speed have none. Numbers are rounded to so many places.
    Rows grow with the square of the vehicles in sight. Observers that share place and heading are lists, and so are vehicles that share place,
    heading and speed; two lists are compared once. A task holds the pairs of two lists at once.
    """
    moving = {"heading", "speed_mps"} <= set(vehicles.columns)
    seen = vehicles if moving else vehicles.select("t", "id", "x", "y", *(F.lit(None).cast("double").alias(c) for c in ("heading", "speed_mps")))
    looking = stored(_lists(observers, "x", "y", "heading"), "looking")
    lists = stored(with_cell(_lists(seen, "x", "y", "heading", "speed_mps"), range_m, "x", "y"), "seen")
    a = with_near_cells(looking.select("t", "x", "y", "heading", F.col("ids").alias("ids_a")), range_m)
    b = lists.select("t", "cx", "cy", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("heading").alias("bh"), "speed_mps", F.col("ids").alias("ids_b"))
    on = ["t", "cx", "cy"]
    here = a.groupBy(*on).agg(F.sum(F.size("ids_a")).cast("double").alias("n")).hint("merge").join(b.groupBy(*on).agg(F.sum(F.size("ids_b")).cast("double").alias("m")), on)
    tasks = _tasks(here, F.col("n") * F.col("m"))
    near = meet(a.repartition(tasks, *on), b.repartition(tasks, *on), on).withColumn("dist_m", distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).where(F.col("dist_m") <= range_m)
    turn = F.atan2(F.col("by") - F.col("y"), F.col("bx") - F.col("x")) - F.col("heading")
    pi = 3.141592653589793
    wrapped = F.pmod(turn + pi, F.lit(2 * pi)) - pi
    towards = (F.cos("bh") * (F.col("x") - F.col("bx")) + F.sin("bh") * (F.col("y") - F.col("by"))) / F.greatest(F.lit(1e-6), F.col("dist_m"))
    hits = near.withColumn("bearing", wrapped).where(F.abs("bearing") <= half_angle).withColumn("closing_mps", F.col("speed_mps") * towards)
    told = [F.col(c) if places is None else F.round(c, places).alias(c) for c in ("dist_m", "bearing", "closing_mps")]
    each = hits.select("t", "ids_a", "ids_b", *told).withColumn("id", F.explode("ids_a")).withColumn("other_id", F.explode("ids_b"))
    return each.where("id <> other_id").select("t", "id", "other_id", "dist_m", "bearing", "closing_mps")
