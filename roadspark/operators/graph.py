"""Routing graph tables, components and batch shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import atan2, backward, distance, forward, lookup, speed_kmh, tag
from roadspark.operators.mapbuild import class_speed_rank, located, routable_ways, way_nodes
from roadspark.plans.store import discard, stored


def _pairs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbouring nodes along routable ways, with the way's attributes."""
    own = routable_ways(ways, nodes)
    w = Window.partitionBy("way_id").orderBy("seq")
    ahead = located(own, nodes).withColumns({f"n_{c}": F.lead(c).over(w) for c in ("node_id", "x", "y")}).withColumn("last_seq", F.max("seq").over(Window.partitionBy("way_id"))).where("n_node_id is not null")
    lanes = F.coalesce(leading_int(tag("lanes")), F.lit(1))
    wide = F.coalesce(tag("lane_width").try_cast("double"), F.lit(C.LANE_WIDTH_M))
    attributes = own.select("way_id", (speed_kmh() / 3.6).alias("speed_mps"), forward().alias("forward"), backward().alias("backward"), (F.coalesce(tag("divider"), F.lit("")) == "yes").alias("divider"), lanes.alias("lanes"), wide.alias("lane_width"), class_speed_rank(tag("highway")).alias("rank"))
    return ahead.join(attributes, "way_id").withColumn("d", distance(F.col("x"), F.col("y"), F.col("n_x"), F.col("n_y")))


def leading_int(text):
    n = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(n >= 1, n)


def _directions():
    there = F.when(F.col("forward"), F.struct(F.lit(True).alias("ahead")))
    back = F.when(F.col("backward"), F.struct(F.lit(False).alias("ahead")))
    return F.explode(F.filter(F.array(there, back), lambda d: d.isNotNull()))


def signal_wait(nodes: DataFrame, signals: DataFrame, full_cycle: bool = False) -> DataFrame:
    """group_id, wait_sec: half of all-red plus the phases' green and yellow (with full_cycle, half the whole cycle)."""
    from roadspark.operators.signals import cycle_length

    phases = F.aggregate("phases", F.lit(0.0), lambda s, p: s + F.coalesce(p["greenSec"], F.lit(0.0)) + F.coalesce(p["yellowSec"], F.lit(0.0)))
    cycle = signals.select("node_id", (F.coalesce("all_red_sec", F.lit(0.0)) + phases).alias("cycle")) if not full_cycle else cycle_length(signals).withColumnRenamed("cycle_sec", "cycle")
    grouped = nodes.select("node_id", tag("join_group").alias("group_id")).where("group_id is not null").join(cycle, "node_id")
    return grouped.where("cycle > 0").groupBy("group_id").agg(F.min_by("cycle", "node_id").alias("c")).select("group_id", (F.col("c") / 2).alias("wait_sec"))


def _members(nodes: DataFrame, used: DataFrame) -> DataFrame:
    return nodes.withColumn("group_id", tag("join_group")).where("group_id is not null").join(used, "node_id", "left_semi").select("node_id", "group_id", "x", "y")


def routing_edges(nodes: DataFrame, ways: DataFrame, signals: DataFrame | None = None, full_cycle: bool = False) -> DataFrame:
    """src, dst, weight_sec, kind, way_id: chain edges along ways and cliques over junction members.

    Inner nodes of a divided two-way road are twins, #fwd and #bwd, one for each direction.
    """
    pairs = _pairs(ways, nodes)
    twin = F.col("divider") & F.col("forward") & F.col("backward")
    side = lambda name, inner, ahead: F.when(twin & inner, F.concat(name, F.when(ahead, F.lit("#fwd")).otherwise(F.lit("#bwd")))).otherwise(F.col(name))
    both = pairs.withColumn("dir", _directions())
    ahead = F.col("dir.ahead")
    a, b = side("node_id", F.col("seq") > 0, ahead), side("n_node_id", F.col("seq") + 1 < F.col("last_seq"), ahead)
    chain = both.select(F.when(ahead, a).otherwise(b).alias("src"), F.when(ahead, b).otherwise(a).alias("dst"), (F.col("d") / F.col("speed_mps")).alias("weight_sec"), F.lit("chain").alias("kind"), "way_id")
    used = way_nodes(routable_ways(ways, nodes)).select("node_id").distinct()
    m = _members(nodes, used)
    clique = m.join(m.select(F.col("node_id").alias("other"), "group_id", F.col("x").alias("ox"), F.col("y").alias("oy")), "group_id").where("node_id <> other")
    weight = distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) / (C.TURN_SPEED_KMH / 3.6)
    if signals is not None:
        clique = clique.join(signal_wait(nodes, signals, full_cycle), "group_id", "left")
        weight = weight + F.coalesce("wait_sec", F.lit(0.0))
    return chain.unionByName(clique.select(F.col("node_id").alias("src"), F.col("other").alias("dst"), weight.alias("weight_sec"), F.lit("junction").alias("kind"), F.lit(None).cast("string").alias("way_id")))


def chain_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """edge_id, src, dst, way_id, length_m, speed_mps, lanes, lanes_per_direction, lane_width, offset_m, rank."""
    two_way = F.col("forward") & F.col("backward")
    both = _pairs(ways, nodes).withColumn("dir", _directions())
    ahead = F.col("dir.ahead")
    return both.select(
        F.concat_ws(":", "way_id", "seq", F.when(ahead, "f").otherwise("b")).alias("edge_id"),
        F.when(ahead, F.col("node_id")).otherwise(F.col("n_node_id")).alias("src"), F.when(ahead, F.col("n_node_id")).otherwise(F.col("node_id")).alias("dst"),
        "way_id", F.col("d").alias("length_m"), "speed_mps", "lanes",
        F.when(two_way, F.greatest(F.lit(1), F.floor(F.col("lanes") / 2).cast("int"))).otherwise(F.col("lanes")).alias("lanes_per_direction"),
        "lane_width", F.when(two_way, F.col("lanes") * F.col("lane_width") / 4).otherwise(0.0).alias("offset_m"), "rank",
    )


def way_terminals(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """node_id, way_id, out_dx, out_dy: unit vectors that lead out of each end of a routable way."""
    w = Window.partitionBy("way_id").orderBy("seq")
    path = located(routable_ways(ways, nodes), nodes).withColumns({f"{p}_{c}": f(c).over(w) for p, f in (("n", F.lead), ("p", F.lag)) for c in ("x", "y")})
    first = path.where("p_x is null and n_x is not null").select("node_id", "way_id", (F.col("n_x") - F.col("x")).alias("dx"), (F.col("n_y") - F.col("y")).alias("dy"))
    last = path.where("n_x is null and p_x is not null").select("node_id", "way_id", (F.col("p_x") - F.col("x")).alias("dx"), (F.col("p_y") - F.col("y")).alias("dy"))
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    unit = lambda c: F.coalesce(F.col(c) / F.when(length > 0, length), F.lit(0.0))
    return first.unionByName(last).select("node_id", "way_id", unit("dx").alias("out_dx"), unit("dy").alias("out_dy"))


def classify_movement(df: DataFrame) -> DataFrame:
    """Adds movement and speed_factor from arr_x, arr_y, dep_x, dep_y."""
    dot = F.col("arr_x") * F.col("dep_x") + F.col("arr_y") * F.col("dep_y")
    cross = F.col("arr_x") * F.col("dep_y") - F.col("arr_y") * F.col("dep_x")
    movement = F.when(dot < C.UTURN_DOT, "uturn").when(atan2(cross, dot) < C.RIGHT_ANGLE_RAD, "right").otherwise("through")
    return df.withColumn("movement", movement).withColumn("speed_factor", lookup(C.MOVEMENT_FACTOR, F.col("movement")))


def junctions(nodes: DataFrame, ways: DataFrame, signals: DataFrame) -> DataFrame:
    """junction_id, primary_node_id, members, approach_speed_mps, signalized."""
    own = routable_ways(ways, nodes)
    m = _members(nodes, way_nodes(own).select("node_id").distinct()).join(signals.select("node_id", F.lit(True).alias("lit")), "node_id", "left")
    speed = m.join(way_terminals(nodes, ways), "node_id").join(own.select("way_id", (speed_kmh() / 3.6).alias("mps")), "way_id").select("group_id", "way_id", "mps").distinct().groupBy("group_id").agg(F.avg("mps").alias("approach_speed_mps"))
    base = m.groupBy("group_id").agg(F.min_by("node_id", F.struct(F.col("lit").isNull(), "node_id")).alias("primary_node_id"), F.array_sort(F.collect_list("node_id")).alias("members"), F.max(F.coalesce("lit", F.lit(False))).alias("signalized"))
    return base.join(speed, "group_id", "left").select(F.col("group_id").alias("junction_id"), "primary_node_id", "members", "approach_speed_mps", "signalized")


def junction_edges(nodes: DataFrame, ways: DataFrame, signals: DataFrame) -> DataFrame:
    """junction_id, src, dst, from_way, to_way, movement, length_m, speed_mps, rank: ordered pairs of a junction's members.

    A member's first way is the one with the least ord (then id) that ends there.
    """
    ends = way_terminals(nodes, ways).join(ways.select("way_id", "ord", class_speed_rank(tag("highway")).alias("rank")), "way_id")
    first = ends.groupBy("node_id").agg(F.min_by(F.struct("way_id", "out_dx", "out_dy", "rank"), F.struct("ord", "way_id")).alias("t"))
    m = _members(nodes, way_nodes(routable_ways(ways, nodes)).select("node_id").distinct()).join(first, "node_id", "left")
    b = m.select("group_id", F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("t").alias("bt"))
    pairs = m.withColumnRenamed("node_id", "src").join(b, "group_id").where("src <> dst")
    zero = F.lit(0.0)
    moved = classify_movement(pairs.withColumns({"arr_x": -F.coalesce("t.out_dx", zero), "arr_y": -F.coalesce("t.out_dy", zero), "dep_x": F.coalesce("bt.out_dx", zero), "dep_y": F.coalesce("bt.out_dy", zero)}))
    speed = junctions(nodes, ways, signals).select(F.col("junction_id").alias("group_id"), "approach_speed_mps")
    return moved.join(speed, "group_id", "left").select(
        F.col("group_id").alias("junction_id"), "src", "dst", F.col("t.way_id").alias("from_way"), F.col("bt.way_id").alias("to_way"), "arr_x", "arr_y", "movement",
        distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")).alias("length_m"),
        F.greatest(F.lit(C.TURN_SPEED_KMH / 3.6 * 0.5), F.col("speed_factor") * F.coalesce("approach_speed_mps", zero)).alias("speed_mps"), F.coalesce("t.rank", F.lit(0)).alias("rank"),
    )


def movements_compatible(a: Column, b: Column) -> Column:
    """Whether two movements (structs of from_way, to_way, movement, arr_x, arr_y) of a junction may run together."""
    opposite = a["arr_x"] * b["arr_x"] + a["arr_y"] * b["arr_y"] < C.UTURN_DOT
    apart = (a["movement"] == "through") | ((a["movement"] == "right") & ~a["to_way"].eqNullSafe(b["to_way"]))
    return F.coalesce(a["from_way"].eqNullSafe(b["from_way"]) | ((a["movement"] == b["movement"]) & opposite & apart), F.lit(False))


def compatible_movements(edges: DataFrame) -> DataFrame:
    """junction_id, src_a, dst_a, src_b, dst_b, compatible: whether two movements of a junction may run together."""
    side = lambda x: edges.select("junction_id", F.col("src").alias(f"src_{x}"), F.col("dst").alias(f"dst_{x}"), F.struct("from_way", "to_way", "movement", "arr_x", "arr_y").alias(x))
    both = side("a").join(side("b"), "junction_id").where("src_a < src_b or (src_a = src_b and dst_a < dst_b)")
    return both.select("junction_id", "src_a", "dst_a", "src_b", "dst_b", movements_compatible(F.col("a"), F.col("b")).alias("compatible"))


def weak_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node_id, component: the least node reachable when directions are ignored. edges: src, dst.

    Labels fall to the least neighbour's and then jump to their own label's label, so rounds grow with the logarithm of
    the diameter; each round is written to the shared folder.
    """
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = stored(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node_id"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node_id").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "node_id"), "node_id").select("node_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # what a root's members have found goes to the root, then every node takes its label's label
        root = hooked.groupBy("old").agg(F.min("label").alias("root")).withColumnRenamed("old", "node_id")
        pulled = hooked.join(root, "node_id", "left").select("node_id", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        jumped = pulled.join(pulled.select(F.col("node_id").alias("label"), F.col("label").alias("far")), "label", "left").select("node_id", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = stored(jumped, "labels")
        labels = step.select("node_id", "label")
        if step.where("label <> old").isEmpty():
            return labels.select("node_id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def _relaxed(arcs: DataFrame, od: DataFrame, hops: int) -> DataFrame:
    """origin, node, cost, hops, before: the least (cost, hops, node before) for each node that some origin's search had to reach."""
    least = lambda df: df.groupBy("origin", "node").agg(F.min(F.struct("cost", "hops", "before")).alias("b")).select("origin", "node", "b.*")
    most = F.coalesce("most_sec", F.lit(float("inf"))) if "most_sec" in od.columns else F.lit(float("inf"))
    wanted = stored(od.groupBy(F.col("src").alias("origin"), F.col("dst").alias("node")).agg(F.max(most).alias("most")), "wanted")
    kind = dict(arcs.dtypes)["src"]
    best = stored(wanted.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(kind).alias("before")), "costs")
    front = best
    while not front.isEmpty():
        # what costs more than all of an origin's destinations, as far as they are reached or may cost, can't lie on a way to them
        reached = wanted.join(best.select("origin", "node", "cost"), ["origin", "node"], "left").groupBy("origin").agg(F.max(F.least("most", F.coalesce("cost", F.lit(float("inf"))))).alias("bound"))
        now, went = front.join(reached, "origin"), None
        for _ in range(hops):
            step = now.join(arcs, now["node"] == arcs["src"]).select("origin", "bound", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("before")).where("cost <= bound")
            now = step.groupBy("origin", "bound", "node").agg(F.min(F.struct("cost", "hops", "before")).alias("b")).select("origin", "bound", "node", "b.*")
            went = now if went is None else went.unionByName(now)
        had = best.select("origin", "node", F.struct("cost", "hops", "before").alias("had"))
        found = least(went.drop("bound")).join(had, ["origin", "node"], "left")
        front = stored(found.where(F.col("had").isNull() | (F.struct("cost", "hops", "before") < F.col("had"))).drop("had"), "front")
        last, best = best, stored(best.join(front.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(front), "costs")
        discard(last)
    return best


def _walked(best: DataFrame, ends: DataFrame) -> DataFrame:
    """od_id, path: the nodes before each end (od_id, origin, node, hops), by jumps of 2^k nodes, the longest first."""
    jump = best.where("before IS NOT NULL").select("origin", "node", "before")
    levels, longest = [stored(jump, "jumps")], ends.agg(F.max("hops")).first()[0] or 0
    while 2 << (len(levels) - 1) <= longest:
        last = levels[-1]
        levels.append(stored(last.join(last.select("origin", F.col("node").alias("before"), F.col("before").alias("far")), ["origin", "before"]).select("origin", "node", F.col("far").alias("before")), "jumps"))
    met = ends.select("od_id", "origin", "node", "hops")
    for k in range(len(levels) - 1, -1, -1):
        further = met.join(levels[k], ["origin", "node"]).select("od_id", "origin", F.col("before").alias("node"), (F.col("hops") - (1 << k)).alias("hops"))
        met = stored(met.unionByName(further), "met")
    return met.groupBy("od_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hops", "node"))), lambda e: e["node"]).alias("path"))


def shortest_paths(edges: DataFrame, od: DataFrame, hops: int = 3, paths: bool = False) -> DataFrame:
    """od_id, found, cost_sec: the least cost from src to dst for every row of od (od_id, src, dst); with paths also path.

    Of equal costs the path of fewest hops counts, then the one through the least node before its end, and so on back. Weights
    are not negative; zero is allowed. A row from a node to itself costs nothing and has that node as its path; rows without a
    way are not found and have an empty path; od_id is distinct. Where od has a column most_sec, only ways that cost less are
    found, and only what costs no more is searched.

    Distinct origins relax their frontiers together: edges are joined on the node, the least (cost, hops, node before) for each
    (origin, node) stays, and only improved ones go on, no further than the origin's farthest destination. A stored round
    takes several hops; rounds end when nothing improves. Paths are read back by jumps that double, so a path of n nodes takes
    log2 n joins.
    """
    arcs = stored(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("weight_sec").alias("w")), "arcs")
    best = _relaxed(arcs, od, hops)
    asked = od.select("od_id", F.col("src").alias("origin"), F.col("dst").alias("node"), (F.col("most_sec") if "most_sec" in od.columns else F.lit(None).cast("double")).alias("most"))
    near = F.col("most").isNull() | (F.col("cost") < F.col("most"))
    costs = asked.join(best.select("origin", "node", "cost", "hops"), ["origin", "node"], "left").withColumn("cost", F.when(near, F.col("cost")))
    found = costs.select("od_id", F.col("cost").isNotNull().alias("found"), F.col("cost").alias("cost_sec"))
    if not paths:
        return found
    ends = stored(costs.where("cost IS NOT NULL").select("od_id", "origin", "node", "hops"), "ends")
    return found.join(_walked(best, ends), "od_id", "left").withColumn("path", F.coalesce("path", F.array().cast(f"array<{dict(edges.dtypes)['src']}>")))


def verify_distances(a: DataFrame, b: DataFrame, rel_tol: float = 1e-6) -> DataFrame:
    """checked, mismatches, max_abs_diff, status of two (od_id, found, cost_sec) tables."""
    both = a.select("od_id", F.col("cost_sec").alias("x")).join(b.select("od_id", F.col("cost_sec").alias("y")), "od_id", "full_outer")
    off = F.abs(F.col("x") - F.col("y"))
    bad = (F.col("x").isNull() != F.col("y").isNull()) | F.coalesce(off > rel_tol * F.greatest(F.lit(1.0), F.abs("x")), F.lit(False))
    out = both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("mismatches"), F.coalesce(F.max(off), F.lit(0.0)).alias("max_abs_diff"))
    return out.withColumn("status", F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"))
