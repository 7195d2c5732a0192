"""Chains: oriented list ranking by pointer doubling, and the merging of ways that meet end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions.tags import tag
from roadspark.plans.store import discard, stored


def rank_lists(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked, rings) of singly linked lists. links: state, succ (null at an end), mark (of the link to succ).

    ranked: state, last, hops: the end of the state's list and the links up to it. rings: state, mark: states of closed lists, with the
    least mark of their ring. Each round doubles how far every pointer looks, so a list of n states takes log2 n rounds,
    all lists at once; rounds are stored, and the one before is deleted. A round that ends no further list leaves rings alone;
    their least marks are whole when a round lowers none.
    """
    now = stored(links.select("state", "succ", F.col("mark").alias("least"), F.when(F.col("succ").isNull(), F.col("state")).alias("last"), F.when(F.col("succ").isNull(), 0).otherwise(1).cast("long").alias("hops")), "lists")
    before = None
    while True:
        size = now.agg(F.count("last"), F.sum(F.when(F.col("last").isNull(), F.xxhash64("state", "least").cast("decimal(20,0)")))).first()
        if size[1] is None or tuple(size) == before:
            return now.where("last IS NOT NULL").select("state", "last", "hops"), now.where("last IS NULL").select("state", F.col("least").alias("mark"))
        before = tuple(size)
        far = now.select(F.col("state").alias("succ"), F.col("succ").alias("succ2"), F.col("least").alias("least2"), F.col("last").alias("last2"), F.col("hops").alias("hops2"))
        open_ = now.where("last IS NULL").drop("last").join(far, "succ").select("state", F.col("succ2").alias("succ"), F.least("least", "least2").alias("least"), F.col("last2").alias("last"), (F.col("hops") + F.col("hops2")).alias("hops"))
        step = stored(now.where("last IS NOT NULL").unionByName(open_.select(*now.columns)), "lists")
        discard(now)
        now = step


def _yes(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("yes", "true", "1"), F.lit(False))


def through_joints(nodes: DataFrame, ways: DataFrame, chosen: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """unit, way_id, at_end, node_id: two rows for each place where exactly two ways meet end to end and nothing is lost by joining them.

    nodes: node_id, tags; ways: way_id, nodes. A unit is a node, or all nodes of one join_group. It is a joint if its nodes occur in
    exactly two ways, none of which is a loop, once in each and at an end, and if no node of it has a signal (signals:
    node_id) or a uturn tag. chosen (node_id): only units that one of these belongs to.
    """
    unit = F.coalesce(tag("join_group"), F.col("node_id"))
    members = nodes.select("node_id", unit.alias("unit"), _yes(tag("uturn")).alias("kept"))
    if signals is not None:
        members = members.join(signals.select("node_id").distinct().withColumn("lit", F.lit(True)), "node_id", "left").withColumn("kept", F.col("kept") | F.coalesce("lit", F.lit(False))).drop("lit")
    if chosen is not None:
        members = members.join(chosen.select("node_id").distinct().join(members.select("node_id", "unit"), "node_id").select("unit").distinct(), "unit", "left_semi")
    at = ways.select("way_id", F.size("nodes").alias("n"), (F.element_at("nodes", 1) == F.element_at("nodes", -1)).alias("loop"), F.posexplode("nodes").alias("pos", "node_id"))
    met = at.join(members.select("node_id", "unit"), "node_id")
    end = F.struct("way_id", (F.col("pos") > 0).alias("at_end"), "node_id")
    per = met.groupBy("unit").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("way_id").alias("ways"), F.bool_and((~F.col("loop")) & ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))).alias("ends"), F.min(end).alias("a"), F.max(end).alias("b"))
    free = members.groupBy("unit").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("unit")
    two = per.where("uses = 2 AND ways = 2 AND ends").join(free, "unit")
    return two.select("unit", F.explode(F.array("a", "b")).alias("e")).select("unit", "e.*")


def _links(joints: DataFrame, ways: DataFrame) -> DataFrame:
    """state, succ, mark: a way driven in either direction (way_id|0 forward, way_id|1 backward) and what follows it."""
    other = joints.select("unit", F.col("way_id").alias("way2"), F.col("at_end").alias("end2"))
    hop = joints.join(other, "unit").where("way_id <> way2")
    # leaving by its end means driving forward; arriving at an end means going on backward
    pair = hop.select(F.concat("way_id", F.when(F.col("at_end"), "|0").otherwise("|1")).alias("state"), F.concat("way2", F.when(F.col("end2"), "|1").otherwise("|0")).alias("succ"), F.col("unit").alias("mark"))
    states = ways.join(joints.select("way_id").distinct(), "way_id", "left_semi").select(F.explode(F.array(F.concat("way_id", F.lit("|0")), F.concat("way_id", F.lit("|1")))).alias("state"))
    return states.join(pair, "state", "left")


def way_chains(joints: DataFrame, ways: DataFrame) -> DataFrame:
    """way_id, into_id, pos, turned: each way that merges, the way it becomes part of, its place there and whether it is turned around.

    joints: unit, way_id, at_end as of through_joints; ways: way_id, ord. The way of a chain with the least (ord, way_id) stays and keeps its
    direction. A ring is cut at its joint with the least unit.
    """
    links = stored(_links(joints, ways), "links")
    ranked, rings = rank_lists(links)
    cut = stored(rings, "rings")
    if not cut.isEmpty():
        closed = links.join(cut.select("state", F.col("mark").alias("least")), "state")
        opened = closed.select("state", F.when(F.col("mark") != F.col("least"), F.col("succ")).alias("succ"), "mark")
        ranked = ranked.unionByName(rank_lists(opened)[0])
    parts = ranked.select(F.substring_index("state", "|", -1).alias("turn"), F.expr("left(state, length(state) - 2)").alias("way_id"), "last", "hops").join(ways.select("way_id", "ord"), "way_id")
    parts = stored(parts, "parts")
    first = parts.groupBy("last").agg(F.min(F.struct("ord", "way_id", "turn")).alias("first"), F.max("hops").alias("most")).where("first.turn = '0'")
    return parts.join(first, "last").select("way_id", F.col("first.way_id").alias("into_id"), (F.col("most") - F.col("hops")).cast("int").alias("pos"), (F.col("turn") == "1").alias("turned"))


def merge_through_ways(nodes: DataFrame, ways: DataFrame, chosen: DataFrame | None = None, signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, merged[way_id, into_id, pos, turned]) after all joints of through_joints are gone.

    ways: way_id, ord, tags, nodes and more. A way that stays keeps its id, tags, direction and other columns and runs over the nodes of its chain,
    ways that were drawn the other way around turned; so its one-way tag still means the same on the ground. Nodes inside
    a joint go, but for the one at which the earlier way of the two ended, which stays as a shape point.
    """
    joints = stored(through_joints(nodes, ways, chosen, signals), "joints")
    merged = stored(way_chains(joints, ways), "merged")
    own = merged.join(ways.select("way_id", "nodes"), "way_id").select("into_id", "pos", F.when(F.col("turned"), F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"))
    lists = own.groupBy("into_id").agg(F.array_sort(F.collect_list(F.struct("pos", "nodes"))).alias("parts"))
    joined = lists.select(F.col("into_id").alias("way_id"), F.flatten(F.transform("parts", lambda p: F.when(p["pos"] == 0, p["nodes"]).otherwise(F.slice(p["nodes"], F.lit(2), F.size(p["nodes"]))))).alias("__nodes"))
    gone = merged.where("way_id <> into_id").select("way_id")
    out = ways.join(gone, "way_id", "left_anti").join(joined, "way_id", "left").withColumn("nodes", F.coalesce("__nodes", "nodes")).select(*ways.columns)
    used = out.select(F.explode("nodes").alias("node_id")).distinct()
    lost = joints.select("node_id").distinct().join(used, "node_id", "left_anti")
    unit = F.coalesce(tag("join_group"), F.col("node_id"))
    inside = nodes.withColumn("__unit", unit).join(joints.select(F.col("unit").alias("__unit")).distinct(), "__unit", "left_semi").select("node_id").join(used, "node_id", "left_anti")
    return nodes.join(inside.unionByName(lost).distinct(), "node_id", "left_anti"), out, merged


def remap_phases(signals: DataFrame, merged: DataFrame) -> DataFrame:
    """signals (node_id, phases, ...) whose phases name the ways that others merged into, each once, in the order of first mention."""
    phase = signals.select("node_id", F.posexplode("phases").alias("k", "phase"))
    named = phase.select("node_id", "k", F.posexplode("phase.wayIds").alias("pos", "way_id")).join(merged.select("way_id", "into_id"), "way_id", "left")
    firsts = named.groupBy("node_id", "k", F.coalesce("into_id", "way_id").alias("way_id")).agg(F.min("pos").alias("pos"))
    lists = firsts.groupBy("node_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "way_id"))), lambda e: e["way_id"]).alias("ids"))
    anew = phase.join(lists, ["node_id", "k"], "left").withColumn("phase", F.col("phase").withField("wayIds", F.coalesce("ids", "phase.wayIds")))
    whole = anew.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "phase"))), lambda e: e["phase"]).alias("__phases"))
    return signals.join(whole, "node_id", "left").withColumn("phases", F.coalesce("__phases", "phases")).select(*signals.columns)
