"""Signal plans, lamp colours over time, groups, queues and preemption."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import lookup

def _pair_cycle(k: int):
    return 4 * F.greatest(F.lit(1.0), F.coalesce(F.col("paired.pairs")[k]["stepSec"], F.lit(C.PAIRED_STEP_SEC)))


def cycle_length(signals: DataFrame) -> DataFrame:
    """node_id, cycle_sec: all phases with an all-red after each, or both pairs of a paired plan with theirs."""
    red = F.greatest(F.lit(0.0), F.coalesce("all_red_sec", F.lit(0.0)))
    at_least_0 = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    phases = F.aggregate("phases", F.lit(0.0), lambda s, p: s + at_least_0(p["greenSec"]) + at_least_0(p["yellowSec"]) + red)
    paired = F.when(F.size("paired.pairs") == 2, _pair_cycle(0) + _pair_cycle(1) + 2 * red).otherwise(0.0)
    return signals.select("node_id", F.when(F.col("scheme") == "paired4way", paired).otherwise(phases).alias("cycle_sec"))


def phase_segments(signals: DataFrame) -> DataFrame:
    """node_id, start, end, color, phase (-1 in all-red), way_ids: one cycle of a plan of phases, laid out."""
    steps = F.array(
        F.struct(F.lit("green").alias("color"), F.greatest(F.lit(0.0), F.coalesce("p.greenSec", F.lit(0.0))).alias("sec"), F.col("phase").alias("phase"), F.col("p.wayIds").alias("way_ids")),
        F.struct(F.lit("yellow").alias("color"), F.greatest(F.lit(0.0), F.coalesce("p.yellowSec", F.lit(0.0))).alias("sec"), F.col("phase").alias("phase"), F.col("p.wayIds").alias("way_ids")),
        F.struct(F.lit("red").alias("color"), F.greatest(F.lit(0.0), F.coalesce("all_red_sec", F.lit(0.0))).alias("sec"), F.lit(-1).alias("phase"), F.lit(None).cast("array<string>").alias("way_ids")),
    )
    rows = signals.where("scheme <> 'paired4way'").select("node_id", "all_red_sec", F.posexplode("phases").alias("phase", "p")).select("node_id", F.col("phase").alias("n"), F.posexplode(steps).alias("k", "s")).where("s.sec > 0")
    end = F.sum("s.sec").over(Window.partitionBy("node_id").orderBy("n", "k"))
    return rows.select("node_id", (end - F.col("s.sec")).alias("start"), end.alias("end"), "s.color", "s.phase", "s.way_ids")


def lamp_state_phases(signals: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (node_id, way_id, t) with color and remaining_sec under plans of phases.

    Green and yellow count down to the segment's end, red to the way's next green; a way in no phase is red for a cycle.
    """
    segs = phase_segments(signals).join(cycle_length(signals), "node_id")
    key = ["node_id", "way_id", "t"]
    local = F.pmod(F.col("t").cast("double"), F.col("cycle_sec"))
    mine = F.coalesce(F.array_contains("way_ids", F.col("way_id")), F.lit(False))
    both = asks.select(*key).distinct().hint("merge").join(segs, "node_id").withColumns({"local": local, "mine": mine})  # asks are many, however few Spark takes them for
    on = F.col("mine") & (F.col("start") <= F.col("local")) & (F.col("local") < F.col("end"))
    until = F.col("start") - F.col("local")
    wait = F.when(F.col("mine") & (F.col("color") == "green"), F.when(until <= 0, until + F.col("cycle_sec")).otherwise(until))
    told = both.groupBy(*key).agg(F.max(F.when(on, F.col("color"))).alias("now"), F.max(F.when(on, F.col("end") - F.col("local"))).alias("left"), F.min(wait).alias("wait"), F.max("cycle_sec").alias("cycle_sec"))
    full = asks.hint("merge").join(told, key, "left")
    return full.select(*asks.columns, F.coalesce("now", F.lit("red")).alias("color"), F.when(F.col("now").isNotNull(), F.col("left")).otherwise(F.coalesce("wait", "cycle_sec", F.lit(0.0))).alias("remaining_sec"))


def lamp_state_paired(signals: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (node_id, way_id, movement, t) with color and remaining_sec under paired plans, in closed form."""
    plans = signals.where("scheme = 'paired4way' and size(paired.pairs) = 2").select("node_id", "all_red_sec", "paired")
    j = asks.join(plans, "node_id", "left")
    red = F.greatest(F.lit(0.0), F.coalesce("all_red_sec", F.lit(0.0)))
    first, second = _pair_cycle(0), _pair_cycle(1)
    master = first + second + 2 * red
    t = F.pmod(F.col("t").cast("double"), master)
    pair = F.when(F.array_contains(F.col("paired.pairs")[0]["wayIds"], F.col("way_id")), 0).when(F.array_contains(F.col("paired.pairs")[1]["wayIds"], F.col("way_id")), 1)
    start = F.when(pair == 0, 0.0).otherwise(first + red)
    own = F.when(pair == 0, first).otherwise(second)
    step = own / 4
    yellow = F.greatest(F.lit(0.0), F.coalesce("paired.yellowSec", F.lit(C.PAIRED_YELLOW_SEC)))
    is_a = F.when(pair == 0, F.col("paired.pairs")[0]["wayIds"][0]).otherwise(F.col("paired.pairs")[1]["wayIds"][0]) == F.col("way_id")
    right = F.col("movement").isin("right", "uturn")
    red_start = F.when(right, F.when(is_a, step).otherwise(3 * step)).otherwise(F.when(is_a, 2 * step).otherwise(0.0))
    red_len = F.when(right, 3 * step).otherwise(step)
    j = j.withColumns({"m": master, "tm": t, "pair": pair, "st": start, "own": own, "y": yellow, "rs": red_start, "rl": red_len})
    active = (F.col("tm") >= F.col("st")) & (F.col("tm") < F.col("st") + F.col("own"))
    wait = F.col("st") - F.col("tm")
    into = F.pmod(F.col("tm") - F.col("st") - F.col("rs"), F.col("own"))
    left = F.col("own") - into
    color = F.when(F.col("pair").isNull() | ~active | (into < F.col("rl")), "red").when(left <= F.col("y"), "yellow").otherwise("green")
    remaining = F.when(F.col("pair").isNull(), 0.0).when(~active, F.when(wait <= 0, wait + F.col("m")).otherwise(wait)).when(into < F.col("rl"), F.col("rl") - into).when(left <= F.col("y"), left).otherwise(left - F.col("y"))
    return j.select(*asks.columns, color.alias("color"), remaining.alias("remaining_sec"))


def group_turn(groups: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (group_id, node_id, t) with active_node_id, local_clock and the node's wait_sec until its own turn."""
    j = asks.join(groups.where("size(member_ids) >= 2").select("group_id", "member_ids", F.greatest(F.lit(1.0), F.coalesce("turn_sec", F.lit(C.GROUP_TURN_SEC))).alias("turn")), "group_id")
    n = F.size("member_ids")
    t = F.pmod(F.col("t").cast("double"), F.col("turn") * n)
    active = F.least(n - 1, F.floor(t / F.col("turn")).cast("int"))
    own = F.array_position("member_ids", F.col("node_id")).cast("int") - 1
    wait = F.when((own < 0) | (own == active), 0.0).otherwise(F.pmod(own - active, n) * F.col("turn") - (t - active * F.col("turn")))
    return j.select(*asks.columns, F.get("member_ids", active).alias("active_node_id"), (t - active * F.col("turn")).alias("local_clock"), wait.alias("wait_sec"))


def lamp_timeline(signals: DataFrame, t0: int, t1: int) -> DataFrame:
    """node_id, way_id, green_sec, yellow_sec, red_sec of plans of phases over [t0, t1): whole cycles counted at once.

    Only the rest of a cycle is laid out, so the work doesn't grow with the time range.
    """
    segs = phase_segments(signals).join(cycle_length(signals), "node_id")
    span, zero = F.lit(float(t1 - t0)), F.lit(0.0)
    whole = F.floor(span / F.col("cycle_sec"))
    begin = F.pmod(F.lit(float(t0)), F.col("cycle_sec"))
    rest = span - whole * F.col("cycle_sec")
    overlap = lambda shift: F.greatest(zero, F.least(F.col("end") + shift, begin + rest) - F.greatest(F.col("start") + shift, begin))
    timed = segs.where("color <> 'red'").withColumn("sec", whole * (F.col("end") - F.col("start")) + overlap(zero) + overlap(F.col("cycle_sec")))
    lit = timed.select("node_id", F.explode("way_ids").alias("way_id"), "color", "sec").groupBy("node_id", "way_id").agg(F.sum(F.when(F.col("color") == "green", F.col("sec")).otherwise(0.0)).alias("green_sec"), F.sum(F.when(F.col("color") == "yellow", F.col("sec")).otherwise(0.0)).alias("yellow_sec"))
    return lit.withColumn("red_sec", span - F.col("green_sec") - F.col("yellow_sec"))


def approach_weights(queue: DataFrame) -> DataFrame:
    """t, junction_id, way_id, weight: waited seconds times the vehicle type's weight; only positive waits count."""
    weight = F.coalesce(lookup(C.DENSITY_WEIGHT, F.col("type")), F.lit(1.0))
    return queue.where("waited_sec > 0").groupBy("t", "junction_id", "way_id").agg(F.sum(F.col("waited_sec") * weight).alias("weight"))


def lamps_of(green: Column, way: Column) -> Column:
    """The lamps an override turns green, as way:movement in order, comma-joined; of the older form both movements of its way."""
    named = F.transform(green, lambda g: F.concat_ws(":", F.trim(g["wayId"]), F.trim(g["movement"])))
    old = F.when(F.trim(way) != "", F.array(F.concat(F.trim(way), F.lit(":right")), F.concat(F.trim(way), F.lit(":through"))))
    return F.array_join(F.array_sort(F.coalesce(named, old, F.array().cast("array<string>"))), ",")


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events of stretches (node_id, epoch) in order -> what each changes. Remembers one hold."""
    where, held = None, None
    for pdf in parts:
        rows = []
        for node, epoch, e, action, force, token, controller, lamps in pdf.itertuples(index=False):
            if (node, epoch) != where:
                where, held = (node, epoch), None
            mine = held is not None and held[0] == token
            if action == "override":
                if held is not None and not mine and not force:
                    rows.append((node, "rejected", token, controller, held[1], e, lamps))
                    continue
                if held is not None and not mine:
                    rows.append((node, "end", *held[:1], held[2], held[1], e, held[3]))
                rows.append((node, "change" if mine else "begin", token, controller, held[1] if mine else e, e, lamps))
                held = (token, held[1] if mine else e, controller, lamps)
            elif held is not None and (mine or force or action == "release_all"):
                rows.append((node, "end", held[0], held[2], held[1], e, held[3]))
                held = None
        yield pd.DataFrame(rows, columns=["node_id", "what", "token", "controller", "since", "event_id", "lamps"])


def override_log(events: DataFrame) -> DataFrame:
    """node_id, what (begin, change, end, rejected), token, controller, since, event_id, lamps: what each event changes, in the order of event_id.

    events: event_id, action (override, release, release_all), node_id, token, controller, force,
    green_lamps array<struct<wayId, movement>>, way_id (the older form). An override of a node that another token holds
    is rejected unless forced; the same token changes its lamps and keeps its since; a release by another token counts only if
    forced. since is the id of the event that began the hold; an end shows the lamps last held.

    A node's events are cut where its state is surely none (after a forced release or a release of all), and each stretch is folded
    in order by a task that remembers one hold.
    """
    freed = ((F.col("action") == "release") & F.coalesce("force", F.lit(False))) | (F.col("action") == "release_all")
    w = Window.partitionBy("node_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    force, who = F.coalesce("force", F.lit(False)).alias("force"), F.coalesce("controller", F.lit("unknown")).alias("controller")
    rows = events.select("node_id", "event_id", "action", force, "token", who, lamps_of(F.col("green_lamps"), F.col("way_id")).alias("lamps"))
    cut = rows.withColumn("epoch", F.coalesce(F.sum(freed.cast("long")).over(w), F.lit(0)))
    ordered = cut.repartition("node_id", "epoch").sortWithinPartitions("node_id", "epoch", "event_id").select("node_id", "epoch", "event_id", "action", "force", "token", "controller", "lamps")
    return ordered.mapInPandas(_fold, "node_id string, what string, token string, controller string, since long, event_id long, lamps string")


def override_holds(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holds[node_id, token, controller, since, until, lamps], rejected[event_id, node_id, reason]) of override_log.

    until is null for holds that last; lamps are those last held. A release of all must come as a row of each node.
    """
    log = override_log(events)
    holds = log.where("what <> 'rejected'").groupBy("node_id", "token", "since").agg(F.max(F.when(F.col("what") == "end", F.col("event_id"))).alias("until"), F.max_by("controller", F.struct("event_id", "what")).alias("controller"), F.max_by("lamps", F.struct("event_id", "what")).alias("lamps"))
    return holds.select("node_id", "token", "controller", "since", "until", "lamps"), log.where("what = 'rejected'").select("event_id", "node_id", F.lit("held by another").alias("reason"))


def preempt_episodes(requests: DataFrame, gap: float = C.PREEMPT_GAP_SEC, clear: float = C.PREEMPT_CLEAR_SEC) -> DataFrame:
    """junction_id, start, clear_until, hold_until, way_id: requests (t, junction_id, way_id) no more than gap apart.

    A request at or after the hold's end begins a new episode; the last one decides the approach.
    """
    w = Window.partitionBy("junction_id").orderBy("t", "way_id")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap).cast("int"), F.lit(1))
    islands = requests.withColumn("fresh", fresh).withColumn("episode", F.sum("fresh").over(w))
    return islands.groupBy("junction_id", "episode").agg(F.min("t").alias("start"), (F.min("t") + clear).alias("clear_until"), (F.max("t") + gap).alias("hold_until"), F.max_by("way_id", F.struct("t", "way_id")).alias("way_id"))


def approaches(signals: DataFrame, nodes: DataFrame, ways: DataFrame, incoming_only: bool = False) -> DataFrame:
    """junction_id, way_id, dx, dy, bearing, rank: the legs of signalled nodes, by bearing.

    A leg points to the way's next node, at its end to the one before. With incoming_only, one-way legs that lead away
    from the node are left out.
    """
    from roadspark.functions.tags import tag
    from roadspark.operators.mapbuild import located

    w = Window.partitionBy("way_id").orderBy("seq")
    path = located(ways, nodes).withColumns({"ox": F.coalesce(F.lead("x").over(w), F.lag("x").over(w)), "oy": F.coalesce(F.lead("y").over(w), F.lag("y").over(w)), "n": F.max("seq").over(Window.partitionBy("way_id"))})
    legs = path.join(signals.select("node_id"), "node_id", "left_semi").join(ways.select("way_id", F.lower(F.trim(F.coalesce(tag("oneway"), F.lit("")))).alias("one")), "way_id")
    if incoming_only:
        legs = legs.where(~(((F.col("one") == "yes") & (F.col("seq") == 0)) | ((F.col("one") == "-1") & (F.col("seq") == F.col("n")))))
    length = F.greatest(F.lit(1e-6), F.sqrt((F.col("ox") - F.col("x")) ** 2 + (F.col("oy") - F.col("y")) ** 2))
    turned = legs.withColumn("bearing", F.atan2(F.col("oy") - F.col("y"), F.col("ox") - F.col("x")))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("bearing", "way_id"))
    return turned.select(F.col("node_id").alias("junction_id"), "way_id", ((F.col("ox") - F.col("x")) / length).alias("dx"), ((F.col("oy") - F.col("y")) / length).alias("dy"), "bearing", rank.alias("rank"))


def signal_groups_build(nodes: DataFrame, signals: DataFrame, selection: DataFrame, turn_sec: float = C.GROUP_TURN_SEC, direction: str = "cw") -> DataFrame:
    """group_id, member_ids, turn_sec, direction: two signalled nodes or more, in order round their centre; ccw turns it about.

    A node in several selected groups stays in the one with the greatest id.
    """
    own = selection.join(signals.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.max("group_id").alias("group_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    round_it = Window.partitionBy("group_id")
    placed = own.withColumn("turn", F.round(F.atan2(F.col("x") - F.avg("x").over(round_it), F.col("y") - F.avg("y").over(round_it)), 9))
    members = F.transform(F.array_sort(F.collect_list(F.struct("turn", "node_id"))), lambda e: e["node_id"])
    made = placed.groupBy("group_id").agg(members.alias("member_ids")).where("size(member_ids) >= 2")
    ordered = F.reverse("member_ids") if direction == "ccw" else F.col("member_ids")
    return made.select("group_id", ordered.alias("member_ids"), F.lit(max(1.0, turn_sec)).alias("turn_sec"), F.lit(direction).alias("direction"))


def lamp_state(asks: DataFrame, overrides: DataFrame, streamed: DataFrame, plans: DataFrame) -> DataFrame:
    """asks (node_id, way_id, movement, t) with color and source: override, then streamed lamp, then the plan's color.

    overrides: node_id, way_id, movement of green lamps; every other lamp of an overridden node is red. streamed: node_id,
    way_id, movement, color; a node with streamed lamps shows green where the asked movement has none. plans: the asks'
    keys with color.
    """
    lamp = ["node_id", "way_id", "movement"]
    held = overrides.select("node_id").distinct().withColumn("held", F.lit(True))
    lit = overrides.select(*lamp).distinct().withColumn("lit", F.lit(True))
    sent = streamed.select("node_id").distinct().withColumn("sent", F.lit(True))
    colors = streamed.groupBy(*lamp).agg(F.min("color").alias("shown"))
    j = asks.join(held, "node_id", "left").join(lit, lamp, "left").join(sent, "node_id", "left").join(colors, lamp, "left").join(plans.select(*lamp, "t", F.col("color").alias("planned")), [*lamp, "t"], "left")
    color = F.when(F.col("held"), F.when(F.col("lit"), "green").otherwise("red")).when(F.col("sent"), F.coalesce("shown", F.lit("green"))).otherwise(F.coalesce("planned", F.lit("red")))
    source = F.when(F.col("held"), "override").when(F.col("sent"), "streamed").otherwise("plan")
    return j.select(*asks.columns, color.alias("color"), source.alias("source"))


def signal_clock(holds: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (node_id, t) with clock_sec: t without the time that any hold (node_id, since, until; null: open) froze before it."""
    w = Window.partitionBy("node_id").orderBy("since", "until")
    end = F.coalesce("until", F.lit(1 << 60))
    known = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("since") > known).cast("int"), F.lit(1))
    islands = holds.withColumn("end", end).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("node_id", "island").agg(F.min("since").alias("a"), F.max("end").alias("b"))
    # islands don't overlap, so an ask needs the last one that began before it and the lengths of those before
    gone = F.coalesce(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).over(Window.partitionBy("node_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = islands.where("node_id IS NOT NULL").select("node_id", F.col("a").alias("at"), F.struct("a", "b", gone.alias("gone")).alias("own"), F.lit(None).cast(asks.schema).alias("ask"))
    marks = asks.select("node_id", F.col("t").alias("at"), F.lit(None).cast(begun.schema["own"].dataType).alias("own"), F.struct(*asks.columns).alias("ask")).unionByName(begun)
    w = Window.partitionBy("node_id").orderBy("at", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.withColumn("on", F.last("own", ignorenulls=True).over(w)).where("ask IS NOT NULL")
    frozen = F.coalesce(F.col("on.gone") + F.greatest(F.lit(0), F.least("on.b", "at") - F.col("on.a")), F.lit(0))
    return last.select("ask.*", (F.col("at") - frozen).alias("clock_sec")).distinct()


def _phases(groups: Column, label: str) -> Column:
    """A phase for each group of way ids, with the default times."""
    made = lambda g, i: F.struct(F.concat(F.lit("ph_"), (i + 1).cast("string")).alias("id"), F.concat(F.lit(label), F.lit(" "), (i + 1).cast("string")).alias("label"), g.alias("wayIds"), F.lit(25.0).alias("greenSec"), F.lit(3.0).alias("yellowSec"))
    return F.transform(groups, made)


def signal_plans(legs: DataFrame, paired: bool = True) -> DataFrame:
    """node_id, scheme, all_red_sec, phases, paired: a default plan for each junction from its legs by bearing (ties: way id).

    legs: junction_id, way_id, bearing. Four legs make two opposite pairs, in the paired scheme or, with paired false, as
    two phases; three make one phase of the two that are nearest to opposite (ties: earlier ones) and one of the third;
    other numbers make a phase for each leg. A junction's legs are gathered in one row: there are as many as ways meet.
    """
    leg = F.struct("bearing", "way_id")
    by = legs.groupBy(F.col("junction_id").alias("node_id")).agg(F.array_sort(F.collect_list(leg)).alias("a"))
    n, at = F.size("a"), lambda i: F.get("a", F.lit(i))
    turn = lambda i, j: F.abs(at(i)["bearing"] - at(j)["bearing"])
    apart = lambda i, j: F.round(F.when(turn(i, j) > math.pi, 2 * math.pi - turn(i, j)).otherwise(turn(i, j)), 9)
    ways = lambda *k: F.array(*(at(i)["way_id"] for i in k))
    first, second, third = apart(0, 1), apart(0, 2), apart(1, 2)
    three = F.when((first >= second) & (first >= third), F.array(ways(0, 1), ways(2))).when(second >= third, F.array(ways(0, 2), ways(1))).otherwise(F.array(ways(1, 2), ways(0)))
    four = F.array(ways(0, 2), ways(1, 3))
    step = lambda g: F.struct(g.alias("wayIds"), F.lit(C.PAIRED_STEP_SEC).alias("stepSec"))
    is_paired = (n == 4) & F.lit(paired)
    grouped = F.when(n == 4, four).when(n == 3, three)
    phases = F.when(is_paired, _phases(F.filter(four, lambda _: F.lit(False)), "Phase")).when(n.isin(3, 4), _phases(grouped, "Phase")).otherwise(_phases(F.transform("a", lambda e: F.array(e["way_id"])), "Approach"))
    pairs = F.when(is_paired, F.struct(F.lit(C.PAIRED_YELLOW_SEC).alias("yellowSec"), F.transform(four, step).alias("pairs")))
    return by.select("node_id", F.when(is_paired, "paired4way").otherwise("phases").alias("scheme"), F.lit(2.0).alias("all_red_sec"), phases.alias("phases"), pairs.alias("paired"))


_MOVE = ("from_way", "to_way", "movement", "arr_x", "arr_y")


def admit_movements(candidates: DataFrame, in_flight: DataFrame) -> DataFrame:
    """The candidates with accepted: at each (t, junction_id), by rank from high to low, then arrived, then vehicle_id, those
    that agree with every movement in flight and every one accepted before.

    candidates: t, junction_id, vehicle_id, rank, arrived and a movement (from_way, to_way, movement, arr_x, arr_y); in_flight:
    t, junction_id and a movement. What waits at one junction at one time is gathered in a row: a lane group has one
    candidate, so there are as many as approach lanes.
    """
    from roadspark.operators.graph import movements_compatible

    move = F.struct(*_MOVE)
    busy = in_flight.groupBy("t", "junction_id").agg(F.collect_list(move).alias("busy"))
    row = F.struct((-F.col("rank")).alias("low"), "arrived", "vehicle_id", move.alias("m"))
    waiting = candidates.groupBy("t", "junction_id").agg(F.array_sort(F.collect_list(row)).alias("c")).join(busy, ["t", "junction_id"], "left")
    kind = dict(candidates.select(move.alias("m"), "vehicle_id").dtypes)
    none = F.array().cast(f"array<struct<vehicle_id:{kind['vehicle_id']},m:{kind['m']}>>")
    free = F.filter("c", lambda e: F.forall(F.coalesce("busy", F.array().cast(f"array<{kind['m']}>")), lambda b: movements_compatible(e["m"], b)))
    taken = F.aggregate(free, none, lambda s, e: F.when(F.forall(s, lambda o: movements_compatible(e["m"], o["m"])), F.concat(s, F.array(F.struct(e["vehicle_id"].alias("vehicle_id"), e["m"].alias("m"))))).otherwise(s))
    won = waiting.select("t", "junction_id", F.explode(F.transform(taken, lambda e: e["vehicle_id"])).alias("vehicle_id"), F.lit(True).alias("accepted"))
    return candidates.join(won.distinct(), ["t", "junction_id", "vehicle_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def preempt_lamps(lamps: DataFrame, episodes: DataFrame) -> DataFrame:
    """lamps with the colour that an episode puts over theirs.

    lamps: t, junction_id, color and a movement; episodes: t, junction_id, clearing and a movement, at most one for a time and
    junction. The approach that is asked for is green; while clearing, other greens turn yellow; afterwards those that
    don't agree with the movement are red.
    """
    from roadspark.operators.graph import movements_compatible

    over = episodes.select("t", "junction_id", "clearing", F.struct(*_MOVE).alias("asked"))
    agrees = movements_compatible(F.col("asked"), F.struct(*_MOVE))
    color = F.when(F.col("asked").isNull(), F.col("color")).when(F.col("asked.from_way").eqNullSafe(F.col("from_way")), "green").when(F.col("clearing"), F.when(F.col("color") == "green", "yellow").otherwise(F.col("color"))).when(agrees, F.col("color")).otherwise("red")
    return lamps.join(over, ["t", "junction_id"], "left").withColumn("color", color).select(*lamps.columns)
