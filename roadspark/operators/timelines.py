"""Green, yellow and red seconds of lamps over a stretch of time: plans, group turns and holds laid over each other in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.operators.signals import cycle_length, override_log, phase_segments
from roadspark.plans.store import stored


def paired_segments(signals: DataFrame) -> DataFrame:
    """node_id, way_id, movement, start, end, color: where lamps of a paired plan are green or yellow in one cycle.

    A lamp runs through its own quarter-steps while its pair has its turn: red first, then green, the end of it yellow; through
    and right begin at different steps. A stretch that passes the end of the turn goes on at its beginning.
    """
    plans = signals.where("scheme = 'paired4way' AND size(paired.pairs) = 2").select("node_id", F.greatest(F.lit(0.0), F.coalesce("all_red_sec", F.lit(0.0))).alias("red"), "paired")
    step = F.greatest(F.lit(1.0), F.coalesce("p.stepSec", F.lit(C.PAIRED_STEP_SEC)))
    first = 4 * F.greatest(F.lit(1.0), F.coalesce(F.col("paired.pairs")[0]["stepSec"], F.lit(C.PAIRED_STEP_SEC)))
    pairs = plans.select("node_id", "red", first.alias("first"), F.greatest(F.lit(0.0), F.coalesce("paired.yellowSec", F.lit(C.PAIRED_YELLOW_SEC))).alias("yellow"), F.posexplode("paired.pairs").alias("pair", "p"))
    ways = pairs.select("*", step.alias("step"), F.posexplode("p.wayIds").alias("k", "way_id")).withColumn("movement", F.explode(F.array(*map(F.lit, ("through", "right")))))
    ways = ways.withColumn("rank", F.row_number().over(Window.partitionBy("node_id", "way_id", "movement").orderBy("pair", "k"))).where("rank = 1")
    right, a = F.col("movement") == "right", F.col("k") == 0
    own, y = 4 * F.col("step"), F.least("yellow", 4 * F.col("step"))
    begin = F.when(right, F.when(a, F.col("step")).otherwise(3 * F.col("step"))).otherwise(F.when(a, 2 * F.col("step")).otherwise(0.0))
    red = F.when(right, 3 * F.col("step")).otherwise(F.col("step"))
    amber = F.greatest(red, own - y)
    parts = F.array(F.struct(F.lit("green").alias("color"), (begin + red).alias("a"), (begin + amber).alias("b")), F.struct(F.lit("yellow").alias("color"), (begin + amber).alias("a"), (begin + own).alias("b")))
    turns = ways.select("node_id", "way_id", "movement", own.alias("own"), F.when(F.col("pair") == 0, 0.0).otherwise(F.col("first") + F.col("red")).alias("at"), F.explode(parts).alias("s"))
    wrapped = turns.withColumn("back", F.explode(F.array(F.lit(0.0), F.col("own"))))
    low, high = F.greatest(F.lit(0.0), F.col("s.a") - F.col("back")), F.least(F.col("own"), F.col("s.b") - F.col("back"))
    return wrapped.select("node_id", "way_id", "movement", (F.col("at") + low).alias("start"), (F.col("at") + high).alias("end"), F.col("s.color").alias("color")).where("start < end")


def plan_segments(signals: DataFrame) -> DataFrame:
    """node_id, way_id, movement (null: any), start, end, color, cycle_sec: the green and yellow stretches of every plan's cycle."""
    phases = phase_segments(signals).where("color <> 'red'").select("node_id", F.explode("way_ids").alias("way_id"), F.lit(None).cast("string").alias("movement"), "start", "end", "color")
    return phases.distinct().unionByName(paired_segments(signals)).join(cycle_length(signals), "node_id")


def in_turns(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """segments as members of groups show them: the plan from its beginning in the node's own turn, red in all others.

    groups: member_ids, turn_sec. A node in several groups takes its turns in the one with the least id. Cycles get as long as a round.
    """
    turn = F.greatest(F.lit(1.0), F.coalesce("turn_sec", F.lit(C.GROUP_TURN_SEC))).alias("turn")
    members = groups.where("size(member_ids) >= 2").select("group_id", turn, F.size("member_ids").alias("n"), F.posexplode("member_ids").alias("i", "node_id"))
    own = members.groupBy("node_id").agg(F.min(F.struct("group_id", "i", "turn", "n")).alias("g"))
    j = segments.join(own, "node_id", "left")
    times = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor(F.col("g.turn") / F.col("cycle_sec")).cast("int")))
    runs = j.withColumn("k", F.explode(times))
    shift = F.col("k") * F.col("cycle_sec")
    into = F.col("g.i") * F.col("g.turn")
    start = F.when(F.col("g").isNull(), F.col("start")).otherwise(into + F.col("start") + shift)
    end = F.when(F.col("g").isNull(), F.col("end")).otherwise(into + F.least(F.col("g.turn"), F.col("end") + shift))
    return runs.select("node_id", "way_id", "movement", start.alias("start"), end.alias("end"), "color", F.coalesce(F.col("g.n") * F.col("g.turn"), "cycle_sec").alias("cycle_sec")).where("start < end")


def hold_pieces(events: DataFrame) -> DataFrame:
    """node_id, since, until (null: open), lamps: stretches in which a hold shows the same lamps. events as of override_log."""
    log = override_log(events).where("what <> 'rejected'")
    w = Window.partitionBy("node_id").orderBy("event_id", F.col("what") != "end")
    return log.withColumn("until", F.lead("event_id").over(w)).where("what <> 'end'").select("node_id", F.col("event_id").alias("since"), "until", "lamps")


def lamp_seconds(signals: DataFrame, lamps: DataFrame, t0: float, t1: float, groups: DataFrame | None = None, holds: DataFrame | None = None) -> DataFrame:
    """node_id, way_id, movement, green_sec, yellow_sec, red_sec of lamps (node_id, way_id, movement) over [t0, t1).

    signals: plans of phases and paired plans; groups: members take turns; holds (node_id, since, until or null, lamps as of lamps_of,
    not overlapping): the named lamps are green, all others of the node red, and the plan's clock stands still. Time outside
    holds is one stretch on that clock, so plans count in whole cycles and at most two ends, whatever the length of time.
    """
    segs = plan_segments(signals)
    segs = in_turns(segs, groups) if groups is not None else segs
    asked = lamps.select("node_id", "way_id", "movement").distinct()
    if holds is None:
        held = asked.select("node_id").distinct().select("node_id", F.lit(0.0).alias("before"), F.lit(0.0).alias("inside"))
        forced = None
    else:
        until = F.coalesce(F.col("until").cast("double"), F.lit(float(t1)))
        pieces = stored(holds.select("node_id", F.col("since").cast("double").alias("since"), until.alias("until"), "lamps").where(F.col("since") < t1), "pieces")
        early = F.greatest(F.lit(0.0), F.least(F.col("until"), F.lit(float(t0))) - F.col("since"))
        inside = F.greatest(F.lit(0.0), F.least(F.col("until"), F.lit(float(t1))) - F.greatest(F.col("since"), F.lit(float(t0))))
        held = pieces.groupBy("node_id").agg(F.sum(early).alias("before"), F.sum(inside).alias("inside"))
        named = pieces.select("node_id", inside.alias("sec"), F.explode(F.array_distinct(F.split("lamps", ","))).alias("lamp"))
        forced = named.groupBy("node_id", "lamp").agg(F.sum("sec").alias("forced"))
    j = asked.join(held, "node_id", "left").withColumns({"before": F.coalesce("before", F.lit(0.0)), "inside": F.coalesce("inside", F.lit(0.0))})
    j = j.withColumn("lamp", F.concat_ws(":", "way_id", "movement"))
    j = j.join(forced, ["node_id", "lamp"], "left") if forced is not None else j.withColumn("forced", F.lit(0.0))
    s = segs.select("node_id", "way_id", F.col("movement").alias("of"), "start", "end", "color", "cycle_sec")
    both = j.join(s, ["node_id", "way_id"], "left").withColumn("fits", F.col("of").isNull() | (F.col("of") == F.when(F.col("movement") == "uturn", "right").otherwise(F.col("movement"))))
    c0 = F.lit(float(t0)) - F.col("before")
    span = F.lit(float(t1 - t0)) - F.col("inside")
    whole = F.floor(span / F.col("cycle_sec"))
    begin, rest = F.pmod(c0, F.col("cycle_sec")), span - whole * F.col("cycle_sec")
    over = lambda shift: F.greatest(F.lit(0.0), F.least(F.col("end") + shift, begin + rest) - F.greatest(F.col("start") + shift, begin))
    sec = F.when(F.col("fits") & (F.col("cycle_sec") > 0), whole * (F.col("end") - F.col("start")) + over(F.lit(0.0)) + over(F.col("cycle_sec"))).otherwise(0.0)
    told = both.withColumn("sec", sec).groupBy("node_id", "way_id", "movement").agg(
        *(F.sum(F.when(F.col("color") == c, F.col("sec")).otherwise(0.0)).alias(c) for c in ("green", "yellow")), F.coalesce(F.max("forced"), F.lit(0.0)).alias("forced")
    )
    green = F.col("green") + F.col("forced")
    return told.select("node_id", "way_id", "movement", green.alias("green_sec"), F.col("yellow").alias("yellow_sec"), (F.lit(float(t1 - t0)) - green - F.col("yellow")).alias("red_sec"))
