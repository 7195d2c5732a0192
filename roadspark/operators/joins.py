"""Junctions that become one: short connectors that go, and nodes that are joined by hand."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import tag
from roadspark.operators.chains import rank_lists
from roadspark.operators.graph import weak_components
from roadspark.plans.store import discard, numbered, stored


def _key(node: str) -> Column:
    return F.concat_ws("@", node, F.col("layer").cast("string"))


TILE_M = 1000.0
MOST_IN_TILE = 100_000
_BOX = ("x0", "x1", "y0", "y1")
_TOLD = "way_id string, turn long, a string, b string, status string, x0 double, x1 double, y0 double, y1 double"


def _sweep(span_m: float):
    """Decides a tile's connectors in their order, as far as none that comes before at one of its groups is undecided.

    Rows out: every connector with its groups (status null: undecided), and, without way_id, each group a that merged into b, with b's box.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        box, wall = {}, {}  # wall: the least turn of an undecided connector at the group

        def find(k: str) -> str:
            while k in parent:
                k = parent[k]
            return k

        rows = pdf.sort_values("turn").to_dict("list")
        for c in ("a", "b"):
            for k, *sides, other in zip(rows[c], *(rows[f"{c}_{x}"] for x in _BOX), rows[f"{c}_other"], strict=True):
                box[k], wall[k] = sides, other if other == other and other is not None else math.inf
        out = []
        for way_id, turn, first, second in zip(rows["way_id"], rows["turn"], rows["a"], rows["b"], strict=True):
            a, b = find(first), find(second)
            status = "dissolved"
            if a != b and turn > min(wall[a], wall[b]):
                wall[a], wall[b], status = min(wall[a], turn), min(wall[b], turn), None
            elif a != b:
                both = [f(x, y) for f, x, y in zip((min, max, min, max), box[a], box[b], strict=True)]
                if math.hypot(both[1] - both[0], both[3] - both[2]) <= span_m:
                    low, high = min(a, b), max(a, b)
                    parent[high], box[low], wall[low] = low, both, min(wall[a], wall[b])
                else:
                    status = "refused"
            out.append((way_id, turn, first, second, status, None, None, None, None))
        told = [(*r[:2], find(r[2]), find(r[3]), *r[4:]) for r in out]
        told += [(None, None, k, find(k), None, *box[find(k)]) for k in parent]
        # groups' names in their order as bytes are Python's order of code points
        return pd.DataFrame(told, columns=[c.split()[0] for c in _TOLD.split(", ")]).astype({"turn": "Int64"} | {x: "float64" for x in _BOX})

    return run


def _tiles(pending: DataFrame, boxes: DataFrame, shift: float) -> tuple[DataFrame, DataFrame]:
    """pending with both groups' boxes, a tile, and a_other, b_other: the least turn of an undecided connector of another tile
    at the group; and the stored table behind it."""
    side = lambda c: boxes.select(F.col("root").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in _BOX))
    met = pending.join(side("a"), "a", "left").join(side("b"), "b", "left")
    at = lambda c: F.coalesce(F.floor((F.col(c) + shift) / TILE_M), F.lit(0))
    placed = met.withColumns({"cx": at("a_x0"), "cy": at("a_y0")})
    full = placed.groupBy("cx", "cy").agg((1 + F.floor(F.count(F.lit(1)) / MOST_IN_TILE)).alias("parts"))
    tile = F.concat_ws(":", "cx", "cy", F.pmod(F.xxhash64("turn"), F.col("parts")))
    tiled = stored(placed.join(full, ["cx", "cy"]).withColumn("tile", tile).drop("cx", "cy", "parts"), "tiled")
    least = tiled.select("tile", "turn", F.explode(F.array("a", "b")).alias("root")).groupBy("root", "tile").agg(F.min("turn").alias("turn"))
    two = least.groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "tile"))), 1, 2).alias("two")).where("size(two) = 2")
    other = lambda c: two.select(F.col("root").alias(c), F.col("two").alias(f"{c}_two"))
    both = tiled.join(other("a"), "a", "left").join(other("b"), "b", "left")
    of = lambda c: F.when(F.col(f"{c}_two")[0]["tile"] == F.col("tile"), F.col(f"{c}_two")[1]["turn"]).otherwise(F.col(f"{c}_two")[0]["turn"]).alias(f"{c}_other")
    return both.select("tile", "way_id", "turn", "a", "b", *(f"{c}_{x}" for c in "ab" for x in _BOX), of("a"), of("b")), tiled


def join_groups(connectors: DataFrame, nodes: DataFrame, max_m: float = C.SHORT_CONNECTOR_M, span_m: float = C.GROUP_SPAN_M) -> tuple[DataFrame, DataFrame]:
    """(connectors with status, groups[node_id, layer, group_id]): short connectors between junctions merge their ends' groups.

    connectors: way_id, ord, start_id, end_id, layer, len; status is dissolved, refused, or kept for those that are longer than max_m or end
    where they begin. In the order of (len, ord, way_id) each short one dissolves and merges its ends' groups unless the box
    around both would be wider than span_m; within one group it dissolves without a test. group_id is the least
    node@layer of a group; every end of a connector has one.

    A connector that comes first of all undecided ones at both its groups finds them as it would in that order. So connectors are dealt
    to tiles of TILE_M by place; each tile decides its own in order, up to those that wait for another tile's, and the next
    round's tiles lie half a tile further. Rounds are as many as tiles follow each other in one chain of connectors in that
    order; they are stored. A tile holds some MOST_IN_TILE connectors at most, fuller ones are split. A connector to a
    node without a place is refused.
    """
    short = (F.col("start_id") != F.col("end_id")) & (F.col("len") <= max_m)
    ends = stored(connectors.select("way_id", F.struct("len", "ord", "way_id").alias("turn"), short.alias("short"), "layer", "start_id", "end_id", _key("start_id").alias("a"), _key("end_id").alias("b")), "connectors")
    points = ends.select("layer", F.explode(F.array("start_id", "end_id")).alias("node_id")).distinct().withColumn("key", _key("node_id"))
    spots = nodes.select("node_id", "x", "y")
    boxes = stored(points.join(spots, "node_id").select(F.col("key").alias("root"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1")), "boxes")
    inside = ends.where("short AND a = b").select("way_id", F.lit("dissolved").alias("status"))
    pending = stored(numbered(ends.where("short AND a <> b").select("way_id", "turn", "a", "b"), "turn").select("way_id", F.col("idx").alias("turn"), "a", "b"), "pending")
    decided, merges, rounds = [ends.where("NOT short").select("way_id", F.lit("kept").alias("status")), inside], [], 0
    while not pending.isEmpty():
        dealt, tiled = _tiles(pending, boxes, TILE_M / 2 * (rounds % 2))
        done = stored(dealt.groupBy("tile").applyInPandas(_sweep(span_m), _TOLD), "decided")
        decided.append(done.where("way_id IS NOT NULL AND status IS NOT NULL").select("way_id", "status"))
        merged = done.where("way_id IS NULL").select(F.col("a").alias("high"), F.col("b").alias("low"), *_BOX)
        into = merged.select("high", "low")
        merges.append(into)
        moved = lambda df, c: df.join(into.withColumnRenamed("high", c), c, "left").withColumn(c, F.coalesce("low", c)).drop("low")  # noqa: E731, B023
        gone = merged.select(F.explode(F.array("low", "high")).alias("root")).distinct()
        old = boxes, pending, tiled
        boxes = stored(boxes.join(gone, "root", "left_anti").unionByName(merged.select(F.col("low").alias("root"), *_BOX).distinct()), "boxes")
        left = stored(moved(moved(done.where("way_id IS NOT NULL AND status IS NULL").select("way_id", "turn", "a", "b"), "a"), "b").select("way_id", "turn", "a", "b"), "left")
        decided.append(left.where("a = b").select("way_id", F.lit("dissolved").alias("status")))
        discard(*(t for t in old if hasattr(t, "_stored_at")))
        pending = stored(left.where("a <> b"), "pending")
        rounds += 1
    status = reduce(DataFrame.unionByName, decided)
    parents = reduce(DataFrame.unionByName, merges, ends.where("false").select(F.lit("").alias("high"), F.lit("").alias("low")))
    # groups hang below those that they merged into: a list from each, all lists followed at once
    linked = points.join(parents.withColumnRenamed("high", "key"), "key", "left").select(F.col("key").alias("state"), F.col("low").alias("succ"), F.lit("").alias("mark"))
    roots = rank_lists(linked)[0].select(F.col("state").alias("key"), F.col("last").alias("group_id"))
    return connectors.join(status, "way_id").select(*connectors.columns, "status"), points.join(roots, "key").select("node_id", "layer", "group_id")


def join_nodes(nodes: DataFrame, ways: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, summary[group_id, members, dissolved]) after each selection of nodes has become one intersection.

    selected: join_id, node_id. A selection takes the whole earlier groups (join_group) of its nodes with it; selections that share
    a node or an earlier group are one. The members get the least earlier group's name, or jg_ and the least join_id where
    there is none. Ways whose two different ends are members of one intersection go if they are pure connectors, none of
    whose inner nodes another way uses or this one twice; inner nodes that are no members go with them. Unknown nodes
    are left out.

    Nodes and groups are the two sides of a graph, selections and earlier groups its hyperedges; its components are found by joins.
    """
    own = nodes.select("node_id", tag("join_group").alias("old"))
    chosen = selected.select(F.col("join_id").cast("string").alias("join_id"), "node_id").join(own, "node_id")
    grouped = own.where("old IS NOT NULL").join(chosen.where("old IS NOT NULL").select("old").distinct(), "old", "left_semi")
    node, group = F.concat(F.lit("n:"), "node_id"), F.concat(F.lit("g:"), "old")
    sides = chosen.select(node.alias("src"), F.concat(F.lit("s:"), "join_id").alias("dst")).unionByName(grouped.select(node.alias("src"), group.alias("dst")))
    parts = stored(weak_components(stored(sides, "sides")), "parts")
    name = F.substring("node_id", 3, 1 << 30)
    names = parts.groupBy("component").agg(F.min(F.when(F.col("node_id").startswith("g:"), name)).alias("old"), F.min(F.when(F.col("node_id").startswith("s:"), name)).alias("join_id"))
    named = names.select("component", F.coalesce("old", F.concat(F.lit("jg_"), "join_id")).alias("group_id"))
    members = stored(parts.where(F.col("node_id").startswith("n:")).join(named, "component").select(name.alias("node_id"), "group_id"), "members")
    tagged = nodes.join(members, "node_id", "left").withColumn("tags", F.when(F.col("group_id").isNotNull(), F.map_concat(F.map_filter("tags", lambda k, v: k != "join_group"), F.create_map(F.lit("join_group"), F.col("group_id")))).otherwise(F.col("tags")))

    side = lambda at, c: members.select(F.col("node_id").alias(at), F.col("group_id").alias(c))
    ends = ways.where("size(nodes) >= 2").select("way_id", F.element_at("nodes", 1).alias("a"), F.element_at("nodes", -1).alias("b")).where("a <> b")
    within = ends.join(side("a", "ga"), "a").join(side("b", "gb"), "b").where("ga = gb").select("way_id", F.col("ga").alias("group_id"))
    inner = ways.join(within, "way_id").select("way_id", "group_id", F.explode(F.slice("nodes", F.lit(2), F.size("nodes") - 2)).alias("node_id"))
    at = ways.select("way_id", F.explode("nodes").alias("node_id"))
    busy = at.join(inner.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    branching = inner.join(busy, "node_id").select("way_id").distinct()
    gone = stored(within.join(branching, "way_id", "left_anti"), "gone")
    lost = inner.join(gone.select("way_id"), "way_id", "left_semi").select("node_id").distinct().join(members, "node_id", "left_anti")
    summary = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).join(gone.groupBy("group_id").agg(F.count(F.lit(1)).alias("dissolved")), "group_id", "left")
    return tagged.join(lost, "node_id", "left_anti").select(*nodes.columns), ways.join(gone.select("way_id"), "way_id", "left_anti"), summary.select("group_id", "members", F.coalesce("dissolved", F.lit(0)).alias("dissolved"))


def ungroup(nodes: DataFrame, picked: DataFrame) -> DataFrame:
    """nodes without the join_group of any node of picked (node_id): all its members stand for themselves again. Ways don't come back."""
    groups = nodes.join(picked.select("node_id").distinct(), "node_id", "left_semi").select(tag("join_group").alias("__group")).where("__group IS NOT NULL").distinct().withColumn("__off", F.lit(True))
    j = nodes.withColumn("__group", tag("join_group")).join(groups, "__group", "left")
    return j.withColumn("tags", F.when(F.col("__off"), F.map_filter("tags", lambda k, v: k != "join_group")).otherwise(F.col("tags"))).select(*nodes.columns)
