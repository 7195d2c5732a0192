"""Vehicle states and positions over time, in batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.plans.store import numbered, stored


def parse_gps(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid fixes, rejected[value, reason]) of JSON messages in the column value; headings wrap into [0, 360)."""
    schema = "vehicleId string, vehicleType string, lat double, lon double, headingDeg double, speedKmh double, ts timestamp"
    read = raw.select("value", F.from_json("value", schema).alias("m"))
    reason = (
        F.when(F.col("m.vehicleId").isNull() | F.col("m.lat").isNull() | F.col("m.lon").isNull(), "missing field")
        .when(~F.col("m.lat").between(-90, 90) | ~F.col("m.lon").between(-180, 180), "position out of range")
        .when(F.col("m.speedKmh") < 0, "negative speed").when(~F.coalesce(F.col("m.vehicleType").isin(*C.VEHICLE_TYPES), F.lit(False)), "unknown type")
    )
    judged = read.withColumn("reason", reason)
    fixes = judged.where("reason is null").select(F.col("m.vehicleId").alias("vehicle_id"), F.col("m.vehicleType").alias("vehicle_type"), "m.lat", "m.lon", F.pmod("m.headingDeg", F.lit(360.0)).alias("heading_deg"), F.col("m.speedKmh").alias("speed_kmh"), "m.ts")
    return fixes, judged.where("reason is not null").select("value", "reason")


def latest_wins_upsert(updates: DataFrame, target: DataFrame | None, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest order among updates and target; updates win ties."""
    rows = updates.withColumn("__new", F.lit(1))
    if target is not None:
        rows = rows.unionByName(target.withColumn("__new", F.lit(0)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*updates.columns), F.struct(order, "__new")).alias("r"))
    return best.select("r.*")


def live_sessions(fixes: DataFrame, timeout: float = C.LIVE_TIMEOUT_SEC) -> DataFrame:
    """vehicle_id, start, end, fixes: runs of fixes (vehicle_id, t) with no gap longer than timeout; end is the last fix."""
    w = Window.partitionBy("vehicle_id").orderBy("t")
    runs = fixes.withColumn("fresh", F.coalesce((F.col("t") - F.lag("t").over(w) > timeout).cast("int"), F.lit(1))).withColumn("session", F.sum("fresh").over(w))
    return runs.groupBy("vehicle_id", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("fixes")).drop("session")


def live_edge_speed(states: DataFrame, free_flow_mps: float, alpha: float = C.EMA_ALPHA) -> DataFrame:
    """edge, tick, live_mps after each tick with vehicles: an average that moves by alpha a tick and falls back to free flow.

    Ticks without vehicles are skipped in closed form: the distance to free flow shrinks by (1 - alpha) each.
    """
    means = states.groupBy("edge", F.col("t").alias("tick")).agg(F.avg("speed_mps").alias("mean"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        live, last, out = free_flow_mps, None, []
        for tick, mean in zip(pdf["tick"].to_numpy(), pdf["mean"].to_numpy(), strict=True):
            idle = 0 if last is None else tick - last - 1
            live = free_flow_mps + (live - free_flow_mps) * (1 - alpha) ** idle
            live += alpha * (mean - live)
            out.append(live)
            last = tick
        return pdf[["edge", "tick"]].assign(live_mps=out)

    return means.groupBy("edge").applyInPandas(run, "edge long, tick long, live_mps double")


def edge_tumbling_stats(states: DataFrame, size: int, slide: int | None = None) -> DataFrame:
    """edge, start, n, avg_mps for windows of size seconds, every slide seconds."""
    slide = slide or size
    starts = F.sequence(F.floor(F.col("t") / slide) * slide - (size // slide - 1) * slide, F.floor(F.col("t") / slide) * slide, F.lit(slide))
    return states.withColumn("start", F.explode(starts)).groupBy("edge", "start").agg(F.count(F.lit(1)).alias("n"), F.avg("speed_mps").alias("avg_mps"))


def lane_neighbors(states: DataFrame) -> DataFrame:
    """t, vehicle_id, ahead_id, gap_m, behind_id, gap_behind_m within each tick, edge and lane."""
    w = Window.partitionBy("t", "edge", "lane").orderBy("dist", "vehicle_id")
    lead, lag = F.lead(F.struct("vehicle_id", "dist", "length_m")).over(w), F.lag(F.struct("vehicle_id", "dist")).over(w)
    n = states.withColumns({"a": lead, "b": lag})
    return n.select("t", "vehicle_id", F.col("a.vehicle_id").alias("ahead_id"), (F.col("a.dist") - F.col("a.length_m") - F.col("dist")).alias("gap_m"), F.col("b.vehicle_id").alias("behind_id"), (F.col("dist") - F.col("length_m") - F.col("b.dist")).alias("gap_behind_m"))


def negative_gaps(states: DataFrame) -> DataFrame:
    """t, vehicle_id, gap_m of vehicles that overlap the one ahead in their lane."""
    return lane_neighbors(states).where("gap_m < 0").select("t", "vehicle_id", "gap_m")


def stuck_vehicles(states: DataFrame, dt: float = 1.0, min_sec: float = C.STUCK_SEC) -> DataFrame:
    """vehicle_id, start, end, stopped_sec: runs of ticks below 0.5 m/s that last longer than min_sec."""
    w = Window.partitionBy("vehicle_id").orderBy("t")
    slow = states.withColumn("slow", F.col("speed_mps") < C.STUCK_SPEED_MPS)
    runs = slow.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy("vehicle_id", "slow").orderBy("t"))).where("slow")
    return runs.groupBy("vehicle_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), (F.count(F.lit(1)) * dt).alias("stopped_sec")).where(F.col("stopped_sec") > min_sec).drop("run")


def interval_stats(trips: DataFrame, every: int, until: int) -> DataFrame:
    """t, active, spawned, completed, avg_trip_sec at the end of each interval. trips: spawn_t, duration, completed."""
    done = F.when(F.col("completed"), F.col("spawn_t") + F.col("duration"))
    event = F.explode(F.array(F.struct(F.col("spawn_t").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("d")), F.struct(done.alias("at"), F.lit(0).alias("s"), F.lit(1).alias("c"), F.col("duration").alias("d"))))
    marks = trips.select(event.alias("e")).where(f"e.at is not null and e.at <= {until}")
    per = marks.groupBy((F.ceil(F.col("e.at") / every) * every).cast("long").alias("t")).agg(F.sum("e.s").alias("s"), F.sum("e.c").alias("c"), F.sum("e.d").alias("d"))
    spine = trips.sparkSession.range(0, until + 1, every).withColumnRenamed("id", "t")
    w = Window.orderBy("t")  # one row per interval, whatever the number of trips
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    return spine.join(F.broadcast(per), "t", "left").select("t", (run("s") - run("c")).alias("active"), run("s").alias("spawned"), run("c").alias("completed"), (run("d") / F.when(run("c") > 0, run("c"))).alias("avg_trip_sec"))


def trip_stats(trips: DataFrame) -> DataFrame:
    """vehicle_type (null: all), n, avg_trip_sec of completed trips."""
    return trips.where("completed").rollup("vehicle_type").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_trip_sec"))


def emergency_stats(events: DataFrame) -> DataFrame:
    """vehicle_type (null: all), n, avg_response_sec, avg_transport_sec of dispatches that reached their depot again.

    events: vehicle_id, vehicle_type, incident_id, event, t.
    """
    at = lambda e: F.min(F.when(F.col("event") == e, F.col("t"))).alias(e)
    per = events.groupBy("vehicle_id", "vehicle_type", "incident_id").agg(at("dispatch"), at("incident_arrival"), at("depot_arrival")).where("depot_arrival is not null")
    return per.groupingSets([["vehicle_type"], []], "vehicle_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("incident_arrival") - F.col("dispatch")).alias("avg_response_sec"), F.avg(F.col("depot_arrival") - F.col("incident_arrival")).alias("avg_transport_sec"))


def vehicle_trace(states: DataFrame, ids: DataFrame) -> DataFrame:
    """vehicle_id, sec, kmh, accel: the first state of each whole second of the chosen vehicles and its change of speed."""
    first = states.join(ids.select("vehicle_id"), "vehicle_id", "left_semi").groupBy("vehicle_id", F.floor("t").alias("sec")).agg(F.min_by("speed_mps", "t").alias("v"))
    w = Window.partitionBy("vehicle_id").orderBy("sec")
    return first.select("vehicle_id", "sec", (F.col("v") * 3.6).alias("kmh"), ((F.col("v") - F.lag("v").over(w)) / (F.col("sec") - F.lag("sec").over(w))).alias("accel"))


def dispatch_top(incidents: DataFrame, vehicles: DataFrame, n: int, reach_m: float) -> DataFrame:
    """incident_id, type, vehicle_id, rank, dist_m: for each incident the n nearest vehicles of each emergency type within reach."""
    from roadspark.operators.spatial import meet, with_cell, with_near_cells

    a = with_near_cells(incidents.select("incident_id", "x", "y"), reach_m)
    b = with_cell(vehicles.where(F.col("vehicle_type").isin(*C.EMERGENCY_TYPES)).select("vehicle_id", F.col("vehicle_type").alias("type"), F.col("x").alias("vx"), F.col("y").alias("vy")), reach_m, "vx", "vy")
    near = meet(a, b, ["cx", "cy"]).withColumn("d2", (F.col("x") - F.col("vx")) ** 2 + (F.col("y") - F.col("vy")) ** 2).where(F.col("d2") <= reach_m**2)
    rank = F.row_number().over(Window.partitionBy("incident_id", "type").orderBy("d2", "vehicle_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("incident_id", "type", "vehicle_id", "rank", F.sqrt("d2").alias("dist_m"))


def lane_vision_cost(states: DataFrame, reach_m: float = 50.0) -> DataFrame:
    """t, id, lane, cost: what slower vehicles ahead in the lane cost, by how much slower and how near they are.

    Vehicles of one place and speed count as one, with their number, on both sides: pairs grow with the different places and
    speeds in reach, not with the square of the vehicles.
    """
    at = ["t", "edge", "lane", "dist", "speed_mps"]
    kinds = states.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    cell = F.floor(F.col("dist") / reach_m)
    a = kinds.select(*at, F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = kinds.select("t", "edge", "lane", F.col("dist").alias("ahead"), F.col("speed_mps").alias("u"), "n", cell.alias("cell"))
    gap = F.col("ahead") - F.col("dist")
    near = a.hint("merge").join(b, ["t", "edge", "lane", "cell"]).where((gap > 0) & (gap < reach_m))
    cost = near.groupBy(*at).agg(F.sum(F.col("n") * F.greatest(F.lit(0.0), F.col("speed_mps") - F.col("u")) * (1 - gap / reach_m)).alias("cost"))
    own = states.select(*at, F.col("vehicle_id").alias("id")).withColumnRenamed("speed_mps", "v").hint("merge")
    met = own.join(cost, ["t", "edge", "lane", "dist"]).where(F.col("v").eqNullSafe(F.col("speed_mps")))
    return met.groupBy("t", "id", "lane").agg(F.sum("cost").alias("cost"))


def incident_lifecycle(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """incident_id, status, t_responding, t_resolved: pending, responding after the first dispatch, resolved when all responders arrived or were recalled.

    events: vehicle_id, incident_id, event (dispatch, incident_arrival, recall), t.
    """
    per = events.groupBy("incident_id", "vehicle_id").agg(F.min(F.when(F.col("event") == "dispatch", F.col("t"))).alias("out"), F.min(F.when(F.col("event").isin("incident_arrival", "recall"), F.col("t"))).alias("there")).where("out is not null")
    all_ = per.groupBy("incident_id").agg(F.min("out").alias("t_responding"), F.bool_and(F.col("there").isNotNull()).alias("done"), F.max("there").alias("last"))
    j = incidents.join(all_, "incident_id", "left")
    status = F.when(F.col("t_responding").isNull(), "pending").when(F.col("done"), "resolved").otherwise("responding")
    return j.select("incident_id", status.alias("status"), "t_responding", F.when(F.col("done"), F.col("last")).alias("t_resolved"))


def lane_change_safe(gaps: DataFrame, ahead_m: float = 5.0, behind_m: float = 6.0, wide_m: float = 2.15, wide_scale: float = 1.5) -> DataFrame:
    """t, vehicle_id, safe: whether the gaps to the target lane's neighbours are wide enough; wider vehicles need half as much again.

    gaps: t, vehicle_id, gap_m, ahead_width, gap_behind_m, behind_width; a missing neighbour is no obstacle.
    """
    need = lambda gap, width, least: F.col(gap).isNull() | (F.col(gap) >= F.when(F.coalesce(F.col(width), F.lit(0.0)) > wide_m, least * wide_scale).otherwise(least))
    return gaps.select("t", "vehicle_id", (need("gap_m", "ahead_width", ahead_m) & need("gap_behind_m", "behind_width", behind_m)).alias("safe"))


def vehicle_destination(states: DataFrame, homes: DataFrame, amenities: DataFrame) -> DataFrame:
    """t, vehicle_id, amenity_id, name, x, y: the home depot of vehicles on their way back (phase 2)."""
    back = states.where("phase = 2").select("t", "vehicle_id").distinct()
    return back.join(homes.select("vehicle_id", "amenity_id").dropDuplicates(["vehicle_id"]), "vehicle_id").join(amenities.select("amenity_id", F.try_element_at("tags", F.lit("name")).alias("name"), "x", "y"), "amenity_id").select("t", "vehicle_id", "amenity_id", "name", "x", "y")


def live_edge_cost(edges: DataFrame, live: DataFrame) -> DataFrame:
    """edge_id, cost_sec: length over the live speed (2 m/s at least; its own speed where none is known)."""
    return edges.join(live, "edge_id", "left").select("edge_id", (F.col("length_m") / F.greatest(F.lit(2.0), F.coalesce("live_mps", "speed_mps"))).alias("cost_sec"))


def remaining_cost(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """trip_id, step, cost_sec: what is left of each trip's route from a step on. steps: trip_id, step, edge_id."""
    from_here = Window.partitionBy("trip_id").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    return steps.join(costs, "edge_id").select("trip_id", "step", F.sum("cost_sec").over(from_here).alias("cost_sec"))


def reroute_decisions(current: DataFrame, fresh: DataFrame, factor: float = 0.85) -> DataFrame:
    """vehicle_id, current_sec, new_sec, switch: a new route is taken only if it costs less than factor of what is left."""
    return current.join(fresh, "vehicle_id", "left").select("vehicle_id", "current_sec", "new_sec", F.coalesce(F.col("new_sec") < factor * F.col("current_sec"), F.lit(False)).alias("switch"))


def fresh_routes(vehicles: DataFrame, steps: DataFrame, edges: DataFrame, live: DataFrame, factor: float = 0.85, hops: int = 3) -> DataFrame:
    """vehicle_id, current_sec, new_sec, switch, path: what is left of each vehicle's route, and a route that costs clearly less, if there is one.

    vehicles: vehicle_id, step, dest_node, emergency, tracked; steps: vehicle_id, step, edge_id, is_junction; edges: edge_id, src, dst,
    length_m, speed_mps; live: edge_id, live_mps. Costs are live ones. Left out are emergency and tracked vehicles, those inside a junction, on
    their last step, or at the end of whose edge their destination is. new_sec and path are null and empty unless the
    route from the end of the current edge costs less than factor of what is left: no search goes further than that.
    """
    from roadspark.operators.routes import route_paths

    costs = live_edge_cost(edges, live)
    priced = steps.join(edges.select("edge_id", F.col("dst").alias("to")), "edge_id").join(costs, "edge_id")
    left = vehicles.where("NOT emergency AND NOT tracked").select("vehicle_id", F.col("step").alias("now"), "dest_node").join(priced, "vehicle_id").where("step >= now")
    current = left.groupBy("vehicle_id", "dest_node").agg(F.max_by("to", -F.col("step")).alias("src"), F.max(F.when(F.col("step") == F.col("now"), F.col("is_junction"))).alias("inside"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("step") > F.col("now"), F.col("cost_sec"))).alias("current_sec"))
    asked = stored(current.where("NOT inside AND n > 1 AND src <> dest_node").select("vehicle_id", "src", F.col("dest_node").alias("dst"), "current_sec"), "asked")
    arcs = edges.join(costs, "edge_id").select("src", "dst", F.col("cost_sec").alias("weight_sec"))
    od = asked.select(F.col("vehicle_id").alias("od_id"), "src", "dst", (factor * F.col("current_sec")).alias("most_sec"))
    found = route_paths(arcs, od, hops=hops).select(F.col("od_id").alias("vehicle_id"), F.col("cost_sec").alias("new_sec"), "path")
    return asked.select("vehicle_id", "current_sec").join(found, "vehicle_id").select("vehicle_id", "current_sec", "new_sec", F.col("new_sec").isNotNull().alias("switch"), "path")


def queue_members(states: DataFrame, gates: DataFrame) -> DataFrame:
    """t, vehicle_id, edge, lane, since, waited_sec: vehicles standing in a lane that is held at its end.

    gates: t, edge, lane of lanes that are held. A wait begins at the first tick a vehicle stands in a held lane and
    begins anew when it moves or the gate opens.
    """
    held = states.join(gates.select("t", "edge", "lane").distinct().withColumn("held", F.lit(True)), ["t", "edge", "lane"], "left")
    w = Window.partitionBy("vehicle_id").orderBy("t")
    on = held.withColumn("on", F.coalesce("held", F.lit(False)) & (F.col("speed_mps") < C.STUCK_SPEED_MPS))
    runs = on.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy("vehicle_id", "on").orderBy("t"))).where("on")
    since = F.min("t").over(Window.partitionBy("vehicle_id", "run"))
    return runs.select("t", "vehicle_id", "edge", "lane", since.alias("since"), (F.col("t") - since).alias("waited_sec"))


def vehicle_world_position(states: DataFrame, edges: DataFrame) -> DataFrame:
    """vehicle_id, t, x, y, heading (radians), lateral_m (to the left): where vehicles are drawn.

    states: vehicle_id, t, edge_id, dist, lane; edges: edge_id, is_junction, ax, ay, bx, by, length_m, arr_x, arr_y, dep_x, dep_y
    (directions at the ends of a junction edge), lanes_per_direction, lane_width, offset_m. Chain edges are straight, with the
    vehicle in the middle of its lane (two at most); junction edges bend towards where the two directions meet, if that
    lies ahead and within three lengths.
    """
    c = F.col
    s = states.select("vehicle_id", "t", "edge_id", "dist", "lane").join(edges, "edge_id")
    along = F.when(c("length_m") > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("dist") / c("length_m")))).otherwise(0.0)
    s = s.withColumns({"u": along, "ex": c("bx") - c("ax"), "ey": c("by") - c("ay"), "det": c("arr_x") * c("dep_y") - c("arr_y") * c("dep_x")})
    s = s.withColumn("reach", F.when(c("is_junction") & (F.abs("det") > 1e-6), (c("ex") * c("dep_y") - c("ey") * c("dep_x")) / c("det")))
    s = s.withColumn("bent", F.coalesce((c("reach") > 0.05) & (c("reach") < F.greatest(F.lit(1.0), c("length_m") * 3)), F.lit(False)))
    s = s.withColumns({"mx": c("ax") + c("arr_x") * c("reach"), "my": c("ay") + c("arr_y") * c("reach"), "v": 1 - c("u")})
    curve = lambda a, m, b: c("v") * c("v") * c(a) + 2 * c("v") * c("u") * c(m) + c("u") * c("u") * c(b)
    slope = lambda a, m, b: 2 * c("v") * (c(m) - c(a)) + 2 * c("u") * (c(b) - c(m))
    s = s.withColumns({"tx": slope("ax", "mx", "bx"), "ty": slope("ay", "my", "by")})
    turned = c("bent") & (F.hypot("tx", "ty") > 1e-6)
    sim_lanes = F.least(F.lit(2), F.greatest(F.lit(1), c("lanes_per_direction")))
    lateral = c("offset_m") + ((sim_lanes - 1) / 2.0 - F.least(c("lane"), sim_lanes - 1)) * c("lane_width")
    return s.select(
        "vehicle_id", "t", F.when(c("bent"), curve("ax", "mx", "bx")).otherwise(c("ax") + c("ex") * c("u")).alias("x"), F.when(c("bent"), curve("ay", "my", "by")).otherwise(c("ay") + c("ey") * c("u")).alias("y"),
        F.when(turned, F.atan2("ty", "tx")).otherwise(F.atan2("ey", "ex")).alias("heading"), F.when(c("is_junction"), 0.0).otherwise(lateral).alias("lateral_m"),
    )


def live_route(snaps: DataFrame, chain_edges: DataFrame, junction_edges: DataFrame) -> DataFrame:
    """id, step, edge_id, is_junction, length_m: the edge that a vehicle was snapped to and the junction edge ahead of it.

    snaps: id, edge_id; chain_edges: edge_id, dst, length_m; junction_edges: edge_id, src, movement, length_m. The least
    "through" edge comes first, then the least of all; a vehicle on a junction edge has no further step.
    """
    ahead = junction_edges.groupBy(F.col("src").alias("dst")).agg(F.min(F.struct((F.col("movement") != "through").alias("turns"), F.col("edge_id").alias("next_id"), F.col("length_m").alias("next_m"))).alias("n"))
    on = snaps.select("id", "edge_id").join(chain_edges.select("edge_id", "dst", "length_m"), "edge_id")
    first = on.select("id", F.lit(0).alias("step"), "edge_id", F.lit(False).alias("is_junction"), "length_m")
    then = on.join(ahead, "dst").select("id", F.lit(1).alias("step"), F.col("n.next_id").alias("edge_id"), F.lit(True).alias("is_junction"), F.col("n.next_m").alias("length_m"))
    crossing = snaps.select("id", "edge_id").join(junction_edges.select("edge_id", "length_m"), "edge_id").select("id", F.lit(0).alias("step"), "edge_id", F.lit(True).alias("is_junction"), "length_m")
    return first.unionByName(then).unionByName(crossing)


def _served():
    """One after the other, incidents (t, incident_id) of a type and part take their nearest vehicles of those that are left."""

    def run(asks: pd.DataFrame, fleet: pd.DataFrame) -> pd.DataFrame:
        fleet = fleet.sort_values("vehicle_id")
        ids, x, y = fleet["vehicle_id"].to_numpy(), fleet["vx"].to_numpy(), fleet["vy"].to_numpy()
        free, out = np.ones(len(ids), dtype=bool), []
        for incident, n, ax, ay in asks.sort_values(["t", "incident_id"])[["incident_id", "n", "x", "y"]].itertuples(index=False):
            if 2 * free.sum() < len(free):
                ids, x, y = ids[free], x[free], y[free]
                free = np.ones(len(ids), dtype=bool)
            if not len(ids):
                break
            d2 = np.where(free, (x - ax) ** 2 + (y - ay) ** 2, np.inf)
            n = min(n, int(free.sum()))
            near = np.flatnonzero(d2 <= np.partition(d2, n - 1)[n - 1])
            sent = near[np.argsort(d2[near], kind="stable")][:n]  # equally near ones by id
            free[sent] = False
            out.append((incident, asks["type"].iloc[0], ids[sent].tolist()))
        return pd.DataFrame(out, columns=["incident_id", "type", "vehicle_ids"])

    return run


def dispatch_nearest(incidents: DataFrame, requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """incident_id, type, requested, vehicle_ids (nearest first), shortfall: what each incident gets, earlier ones (t, then id) first.

    incidents: incident_id, t, x, y, part; requests: incident_id, type, n; vehicles: vehicle_id, vehicle_type, x, y, part, active,
    responding. Only emergency types are sent, only active vehicles that don't respond yet, and only to incidents of their
    part of the road network, such as graph.weak_components tells (else there is no route); null parts meet nobody. A
    vehicle that is sent is gone for later incidents, however far they are apart.

    Types and parts don't compete, so each pair of them is served on its own. Every incident that comes to its turn takes one
    vehicle at least, so no more incidents than the fleet has vehicles get any: incidents are numbered over all
    partitions, and a task holds its fleet and as many incidents, nothing that grows with the incidents.
    """
    wanted = requests.where(F.col("type").isin(*C.EMERGENCY_TYPES) & (F.col("n") > 0)).select("incident_id", "type", F.col("n").cast("long").alias("n"))
    free = stored(vehicles.where("active AND NOT responding AND part IS NOT NULL").select("vehicle_id", F.col("vehicle_type").alias("type"), "part", F.col("x").cast("double").alias("vx"), F.col("y").cast("double").alias("vy")), "fleet")
    fleets = free.groupBy("type", "part").agg(F.count(F.lit(1)).alias("size"))
    asks = incidents.select("incident_id", "t", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "part").join(wanted, "incident_id").join(fleets, ["type", "part"])
    order = stored(numbered(asks, "type", "part", "t", "incident_id", name="place"), "asks")
    first = order.groupBy("type", "part").agg(F.min("place").alias("first"))
    due = order.join(first, ["type", "part"]).where("place - first < size").select("type", "part", "incident_id", "t", "x", "y", "n")
    kinds = dict(vehicles.dtypes)["vehicle_id"], dict(incidents.dtypes)["incident_id"]
    sent = due.groupBy("type", "part").cogroup(free.groupBy("type", "part")).applyInPandas(_served(), f"incident_id {kinds[1]}, type string, vehicle_ids array<{kinds[0]}>")
    got = F.coalesce("vehicle_ids", F.array().cast(f"array<{kinds[0]}>"))
    return wanted.join(incidents.select("incident_id"), "incident_id").join(sent, ["incident_id", "type"], "left").select("incident_id", "type", F.col("n").alias("requested"), got.alias("vehicle_ids"), (F.col("n") - F.size(got)).alias("shortfall"))
