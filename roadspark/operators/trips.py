"""Trips, depots and fleets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.functions.tags import tag
from roadspark.operators.spatial import nearest_node


def apportion_counts(spark: SparkSession, total: int, weights: dict[str, float] | None = None) -> DataFrame:
    """type, n: whole numbers that add up to total, by largest remainder (ties: the order given)."""
    rows = list((weights or C.VEHICLE_MIX).items())
    df = spark.range(len(rows)).select("id", F.get(F.array(*(F.lit(k) for k, _ in rows)), F.col("id").cast("int")).alias("type"), F.get(F.array(*(F.lit(float(w)) for _, w in rows)), F.col("id").cast("int")).alias("w"))
    everything = Window.partitionBy(F.lit(0))  # a row per vehicle type
    raw = df.withColumn("raw", F.lit(float(total)) * F.col("w") / F.sum("w").over(everything)).withColumn("n", F.floor("raw"))
    left = F.lit(total) - F.sum("n").over(everything)
    rank = F.row_number().over(everything.orderBy((F.col("raw") - F.col("n")).desc(), "id"))
    return raw.withColumn("extra", (rank <= left).cast("long")).select("type", (F.col("n") + F.col("extra")).alias("n"))


def find_depots(amenities: DataFrame, buildings: DataFrame, nodes: DataFrame) -> DataFrame:
    """type, depot_id, name, x, y, node_id: hospitals (amenities and buildings), fire and police stations, the nearest node each.

    A hospital building counts unless an amenity already lies in it; where there are no fire stations, police stations
    serve for them, and the other way round.
    """
    from roadspark.operators.mapbuild import polygon_measures

    named = amenities.select(tag("amenity").alias("kind"), F.col("amenity_id").alias("depot_id"), tag("name").alias("name"), "x", "y", "building_id")
    hospital = named.where("kind = 'hospital'")
    houses = buildings.where(tag("building") == "hospital").join(hospital.where("building_id is not null").select("building_id").distinct(), "building_id", "left_anti")
    centre = polygon_measures(houses).select("building_id", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))
    house = houses.join(centre, "building_id").select(F.lit("hospital").alias("kind"), F.col("building_id").alias("depot_id"), tag("name").alias("name"), "x", "y")
    stations = named.where("kind in ('hospital', 'police', 'fire_station')").drop("building_id").unionByName(house)
    there = stations.select("kind").distinct()
    either = F.when(F.col("kind") == "fire_station", "police").when(F.col("kind") == "police", "fire_station")
    lent = stations.where("kind in ('police', 'fire_station')").withColumn("kind", either).join(there, "kind", "left_anti")
    serves = F.when(F.col("kind") == "hospital", "ambulance").when(F.col("kind") == "police", "police").otherwise("firetruck")
    all_ = stations.unionByName(lent).withColumn("type", serves)
    spots = all_.select(F.col("depot_id").alias("id"), "x", "y").distinct()
    near = nearest_node(spots, nodes).select(F.col("id").alias("depot_id"), "node_id")
    return all_.join(near, "depot_id", "left").select("type", "depot_id", F.coalesce("name", F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))).alias("name"), "x", "y", "node_id")


def assign_depots(vehicles: DataFrame, depots: DataFrame) -> DataFrame:
    """id, depot_id, start_node: emergency vehicles go round their type's depots in order of id."""
    order = depots.select("type", "depot_id", "node_id", (F.row_number().over(Window.partitionBy("type").orderBy("depot_id")) - 1).alias("slot"), F.count(F.lit(1)).over(Window.partitionBy("type")).alias("slots"))
    sizes = order.select("type", "slots").distinct()
    numbered = vehicles.where(F.col("type").isin(*C.EMERGENCY_TYPES)).withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("id")) - 1)
    return numbered.join(sizes, "type").withColumn("slot", F.pmod(F.col("n").cast("long"), F.col("slots")).cast("int")).join(order.drop("slots"), ["type", "slot"]).select("id", "depot_id", F.col("node_id").alias("start_node"))


def trip_summary(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """vehicle_type, n, min_m, max_m, avg_m of the straight distance from start to end. trips: vehicle_type, start_node, end_node."""
    a, b = (nodes.select(F.col("node_id").alias(f"{p}_node"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y")) for p in ("start", "end"))
    d = trips.join(a, "start_node").join(b, "end_node").withColumn("d", F.sqrt((F.col("start_x") - F.col("end_x")) ** 2 + (F.col("start_y") - F.col("end_y")) ** 2))
    return d.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("min_m"), F.max("d").alias("max_m"), F.avg("d").alias("avg_m"))


MODULUS = 2147483648


def drawn(*parts, seed: int = 1):
    """A number in [0, 2^31) that follows from the given whole-number columns and the seed, the same in any engine."""
    mixed = F.lit(seed).cast("long")
    for part, prime in zip(parts, (7919, 104729, 1299709), strict=False):
        mixed = mixed + part * F.lit(prime).cast("long")
    step = lambda x: (x % F.lit(MODULUS).cast("long") * F.lit(1103515245).cast("long") + 12345) % MODULUS
    once = step(mixed)
    return step(once.bitwiseXOR(F.shiftright(once, 15)))  # without the shift, draws of neighbouring parts would differ by a constant


def uniform(low, high, *parts, seed: int = 1):
    return low + (high - low) * (drawn(*parts, seed=seed) / F.lit(float(MODULUS)))


def sample_endpoints(ids: DataFrame, nodes: DataFrame, seed: int, min_m: float, tries: int = 50) -> DataFrame:
    """id, start_node, end_node: for each id the first drawn pair of different nodes at least min_m apart, else the last different one.

    Stored rounds of one, two, four, ... tries; only ids without a far pair go on.
    """
    from roadspark.operators.spatial import meet
    from roadspark.plans.store import numbered, stored

    order = stored(numbered(nodes.select("node_id", "x", "y"), "node_id"), "order")
    n = order.count()
    pick = lambda which: F.floor(drawn(F.col("id"), F.col("try"), F.lit(which), seed=seed) * F.lit(n).cast("long") / MODULUS)
    a, b = (order.select(F.col("idx").alias(f"i{k}"), F.col("node_id").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in (0, 1))
    far = (F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2 >= min_m**2
    none = F.lit(None).cast(f"struct<n0:{dict(nodes.dtypes)['node_id']},n1:{dict(nodes.dtypes)['node_id']}>")
    todo, done, at, some = ids.select("id").distinct().withColumn("last", none), None, 0, 1
    while at < tries:
        upto = min(tries, at + some)
        pairs = todo.select("id", F.explode(F.sequence(F.lit(at).cast("long"), F.lit(upto - 1).cast("long"))).alias("try"))
        drawn_pairs = meet(meet(pairs.withColumns({"i0": pick(0), "i1": pick(1)}).where("i0 <> i1"), a, ["i0"]), b, ["i1"])
        best = drawn_pairs.groupBy("id").agg(F.min_by(F.struct("n0", "n1"), F.when(far, F.col("try"))).alias("good"), F.max_by(F.struct("n0", "n1"), "try").alias("now"))
        went = stored(todo.hint("merge").join(best, "id", "left").select("id", "good", F.coalesce("now", "last").alias("last")), "drawn")
        found, todo = went.where("good IS NOT NULL").select("id", F.col("good").alias("p")), went.where("good IS NULL").select("id", "last")
        done, at, some = (found if done is None else done.unionByName(found)), upto, 2 * some
        if todo.isEmpty():
            break
    rest = todo.where("last IS NOT NULL").select("id", F.col("last").alias("p"))
    chosen = rest if done is None else done.unionByName(rest)
    return chosen.select("id", F.col("p.n0").alias("start_node"), F.col("p.n1").alias("end_node"))


# Per vehicle type, the range of each attribute.
PROFILES = {
    "car": {"length": (4.0, 5.1), "width": (1.6, 1.95), "height": (1.35, 1.65), "weight_kg": (1000, 1900), "max_speed_kmh": (90, 120), "accel_mps2": (2.2, 3.2)},
    "motorcycle": {"length": (1.8, 2.3), "width": (0.65, 0.9), "height": (1.05, 1.4), "weight_kg": (110, 260), "max_speed_kmh": (80, 110), "accel_mps2": (3.0, 4.5)},
    "bus": {"length": (7.0, 10.0), "width": (2.4, 2.6), "height": (3.0, 3.6), "weight_kg": (8000, 14000), "max_speed_kmh": (60, 85), "accel_mps2": (0.8, 1.4)},
    "truck": {"length": (6.0, 12.0), "width": (2.3, 2.6), "height": (2.5, 3.8), "weight_kg": (5000, 16000), "max_speed_kmh": (60, 80), "accel_mps2": (0.7, 1.3)},
    "ambulance": {"length": (5.5, 6.5), "width": (2.0, 2.3), "height": (2.4, 2.85), "weight_kg": (2500, 4500), "max_speed_kmh": (100, 130), "accel_mps2": (2.6, 3.6)},
    "firetruck": {"length": (8.5, 11.0), "width": (2.4, 2.6), "height": (3.0, 3.4), "weight_kg": (12000, 20000), "max_speed_kmh": (80, 100), "accel_mps2": (1.6, 2.4)},
    "police": {"length": (4.5, 5.0), "width": (1.8, 2.0), "height": (1.45, 1.65), "weight_kg": (1600, 2200), "max_speed_kmh": (110, 140), "accel_mps2": (3.0, 4.2)},
}
MIN_AGE, MAX_AGE = 16, 80


def vehicle_attributes(vehicles: DataFrame, seed: int) -> DataFrame:
    """vehicles (id, type) with length, width, height, weight_kg, max_speed_kmh, accel_mps2 drawn from the type's ranges, and driver_age."""
    from roadspark.functions.tags import lookup

    out = {}
    for k, name in enumerate(next(iter(PROFILES.values()))):
        low, high = (lookup({t: float(p[name][e]) for t, p in PROFILES.items()}, F.col("type")) for e in (0, 1))
        out[name] = F.round(uniform(low, high, F.col("id"), F.lit(k), seed=seed), 0 if name == "weight_kg" else 2)
    age = MIN_AGE + F.floor(drawn(F.col("id"), F.lit(9), seed=seed) * F.lit(MAX_AGE - MIN_AGE + 1) / MODULUS)
    return vehicles.withColumns(out | {"driver_age": age})


def response_time(vehicles: DataFrame, seed: int) -> DataFrame:
    """vehicles (id, type, driver_age) with response_time_sec: slower for the very young and the old, faster for emergency drivers."""
    base = F.when(F.col("type").isin(*C.EMERGENCY_TYPES), 0.55).otherwise(0.75)
    age = F.col("driver_age")
    base = base + F.when(age < 21, 0.15 * (21 - age) / 5).when(age > 65, 0.10 * (age - 65) / 10).otherwise(0.0)
    spread = uniform(F.lit(-0.1), F.lit(0.15), F.col("id"), F.lit(10), seed=seed)
    return vehicles.withColumn("response_time_sec", F.round(F.greatest(F.lit(0.35), F.least(F.lit(2.0), base + spread)), 3))


def fleet_vehicles(amenities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fleet_vehicles, duplicates[vehicle_id, n]): amenities' fleets (id, vehicleType, vehicles(id, ...)) flattened."""
    fleets = amenities.select("amenity_id", F.explode_outer("fleets").alias("f"))
    flat = fleets.select("amenity_id", F.col("f.id").alias("fleet_id"), F.col("f.vehicleType").alias("vehicle_type"), F.explode_outer("f.vehicles").alias("v"))
    rows = flat.select("amenity_id", "fleet_id", "vehicle_type", F.col("v.id").alias("vehicle_id"), "v.length", "v.maxSpeed")
    return rows, rows.where("vehicle_id is not null").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def generate_trips(spark: SparkSession, nodes: DataFrame, depots: DataFrame, count: int, seed: int, min_m: float = 200.0, mix: dict[str, float] | None = None) -> DataFrame:
    """id, type, start_node, end_node, home_depot and attributes of count vehicles: types in exact numbers, in shuffled order.

    Emergency vehicles start at their depot, whatever the distance to their end; others get endpoints min_m apart. nodes
    are the ones that trips may use (the largest strong component).
    """
    from roadspark.plans.store import numbered

    sizes = [(r["type"], r["n"]) for r in apportion_counts(spark, count, mix).collect()]  # a row per vehicle type
    shuffled = numbered(spark.range(count).withColumn("key", drawn(F.col("id"), F.lit(11), seed=seed) * F.lit(MODULUS).cast("long") + F.col("id")), "key", name="place")
    kind, upto = F.lit(None).cast("string"), count
    for name, n in reversed(sizes):
        kind = F.when(F.col("place") < upto, name).otherwise(kind) if n else kind
        upto -= n
    vehicles = shuffled.select("id", kind.alias("type"))
    ends = sample_endpoints(vehicles.select("id"), nodes, seed, min_m)
    home = assign_depots(vehicles, depots).withColumnRenamed("start_node", "home_node")
    placed = vehicles.join(ends, "id", "left").join(home, "id", "left")
    moved = placed.select("id", "type", F.coalesce("home_node", "start_node").alias("start_node"), "end_node", F.col("depot_id").alias("home_depot"))
    return response_time(vehicle_attributes(moved, seed), seed)
