"""Incidents drawn by seed: kinds, places with fallbacks, and a limit on how many may be open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions.tags import tag
from roadspark.operators.sessions import admitted_spans
from roadspark.operators.trips import MODULUS, drawn
from roadspark.plans.store import numbered, stored

# Kinds in the order in which they are drawn, with the vehicles they ask for, and the buildings they prefer (None: any;
# a road point for accidents).
KINDS = ("fire", "medical", "accident", "crime")
COUNTS = {"fire": {"firetruck": 2, "ambulance": 1}, "medical": {"ambulance": 1}, "accident": {"ambulance": 1, "police": 1}, "crime": {"police": 2}}
PREFERRED = {"fire": ("residential", "commercial", "industrial", "retail"), "crime": ("civic", "commercial")}
MOST_PENDING, INTERVAL_SEC = 8, 120


def _pick(size: Column, field: int, seed: int) -> Column:
    return F.floor(drawn(F.col("attempt"), F.lit(field), seed=seed) * size / MODULUS)


def _pools(buildings: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(pool, idx, of_x, of_y of each building in each pool, size by pool): all buildings, and those that a kind prefers, by id."""
    centre = lambda c: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[c]) / F.size("polygon")
    spots = buildings.where("size(polygon) > 0").select("building_id", F.coalesce(tag("building"), F.lit("")).alias("kind"), centre("x").alias("of_x"), centre("y").alias("of_y"))
    pools = F.filter(F.array(F.lit("any"), *(F.when(F.col("kind").isin(*kinds), k) for k, kinds in PREFERRED.items())), lambda p: p.isNotNull())
    ranked = stored(numbered(spots.withColumn("pool", F.explode(pools)), "pool", "building_id", name="at"), "pools")
    sizes = ranked.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()
    first = F.create_map(*(F.lit(x) for r in sizes for x in (r["pool"], r["first"]))) if sizes else F.create_map().cast("map<string,bigint>")
    return ranked.select("pool", (F.col("at") - F.element_at(first, F.col("pool"))).alias("idx"), "of_x", "of_y"), {r["pool"]: r["n"] for r in sizes}


def place_incidents(attempts: DataFrame, buildings: DataFrame, ways: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """attempts (attempt, ...) with kind, x and y. Fires and crimes are at buildings they prefer, else at any; medical emergencies at any
    building, else on a road; accidents on a road, else at any building. Without any place x and y are null.

    A building counts with the mean of its corners. A road point is drawn on a stretch of a way of two nodes or more. The driver
    sees the sizes of the pools.
    """
    pools, sizes = _pools(buildings)
    roads = stored(numbered(ways.where("size(nodes) >= 2").select("way_id", "nodes"), "way_id"), "roads")
    n_roads = roads.count()
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (_pick(F.lit(len(KINDS)), 0, seed) + 1).cast("int"))
    own = F.when(F.col("kind") == "fire", F.lit("fire" if sizes.get("fire") else "any")).when(F.col("kind") == "crime", F.lit("crime" if sizes.get("crime") else "any")).otherwise("any")
    on_road = F.lit(n_roads > 0) & ((F.col("kind") == "accident") | ((F.col("kind") == "medical") & F.lit(not sizes)))
    size = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("pool")), F.lit(0)) if sizes else F.lit(0)
    chosen = attempts.withColumn("kind", kind).withColumn("pool", F.when(on_road, "road").otherwise(own))
    chosen = chosen.withColumn("idx", F.when(on_road, _pick(F.lit(n_roads), 1, seed)).otherwise(_pick(size, 1, seed)))
    housed = chosen.join(pools, ["pool", "idx"], "left")
    # the stops of roads are rows: an attempt meets the two it needs, not the whole of a long road
    on = F.when(F.col("pool") == "road", F.col("idx")).otherwise(-1 - F.pmod(F.col("attempt"), F.lit(1 << 40)))  # others spread over all tasks, and meet none
    step = F.floor(drawn(F.col("attempt"), F.lit(2), seed=seed) * (F.col("stops") - 1) / MODULUS)
    j = housed.withColumn("road", on).hint("merge").join(roads.select(F.col("idx").alias("road"), F.size("nodes").alias("stops")), "road", "left").withColumn("step", step)
    at_road = roads.select(F.col("idx").alias("road"), F.posexplode("nodes").alias("seq", "node_id")).hint("merge").join(nodes.select("node_id", "x", "y"), "node_id")
    stop = lambda c, k: at_road.select("road", (F.col("seq").cast("long") - k).alias("step"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")).hint("merge")
    met = j.withColumn("share", drawn(F.col("attempt"), F.lit(3), seed=seed) / F.lit(float(MODULUS))).join(stop("a", 0), ["road", "step"], "left").join(stop("b", 1), ["road", "step"], "left")
    at = lambda c: F.coalesce(F.col(f"of_{c}"), F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("share")).alias(c)
    return met.select(*attempts.columns, "kind", at("x"), at("y"))


def incident_generator(attempts: DataFrame, buildings: DataFrame, ways: DataFrame, nodes: DataFrame, seed: int, most: int = MOST_PENDING) -> DataFrame:
    """incident_id, attempt, t, kind, x, y, counts: the attempts that become incidents, numbered from 1 in the order of time.

    attempts: attempt (whole number), t, open_sec: how long its incident would stay open. An attempt while `most` are open, or one that
    finds no place, gives nothing; the next one tries anew. An incident that ends just when an attempt comes has ended.
    Stretches in which no more than `most` would overlap need no order; others are swept by a task that remembers `most`.
    """
    placed = stored(place_incidents(attempts, buildings, ways, nodes, seed).where("x IS NOT NULL AND y IS NOT NULL"), "placed")
    spans = placed.select(F.lit("all").alias("gate"), F.lpad(F.col("attempt").cast("string"), 20, "0").alias("vehicle_id"), F.lit(1).cast("long").alias("session"), F.col("t").alias("start"), (F.col("t") + F.col("open_sec")).alias("until"), F.lit(True).alias("removed"))
    taken = admitted_spans(spans, most).select(F.col("vehicle_id").cast("long").alias("attempt"))
    made = numbered(placed.join(taken, "attempt"), "t", "attempt")
    counts = F.create_map(*(x for k, v in COUNTS.items() for x in (F.lit(k), F.create_map(*(F.lit(y) for kv in v.items() for y in kv)))))
    return made.select((F.col("idx") + 1).alias("incident_id"), "attempt", "t", "kind", "x", "y", F.element_at(counts, F.col("kind")).alias("counts"))
