"""Connected components by alternating star operations; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.plans.store import discard, stored

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is joined to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are joined to the least of them. edges: v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> node, component: the least node reachable, for every node with an edge to another.

    Self-loops, repeated edges and null ends count for nothing; no edges give an empty table.
    """
    one = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    state = stored(one, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, last = tuple(now), state
        state = stored(_small_star(_large_star(state).distinct()).distinct(), "edges")
        discard(last)
    raise RuntimeError("components did not settle")
