"""Incidents: fallbacks where buildings, preferred ones or roads are missing, and the limit on open ones."""

from roadspark.operators.incidents import COUNTS, incident_generator, place_incidents


def tables(spark, building=(), roads=True):
    buildings = spark.createDataFrame([(f"b{k}", {"building": t} if t else {}, [(4.0 * k, 0.0), (4.0 * k + 2, 0.0), (4.0 * k + 1, 3.0)]) for k, t in enumerate(building)], "building_id string, tags map<string,string>, polygon array<struct<x:double,y:double>>")
    ways = spark.createDataFrame([("w", ["a", "b", "c"]), ("dot", ["a"])] if roads else [], "way_id string, nodes array<string>")
    nodes = spark.createDataFrame([("a", 100.0, 0.0), ("b", 110.0, 0.0), ("c", 110.0, 10.0)], "node_id string, x double, y double")
    return buildings, ways, nodes


def test_places(spark):
    tries = spark.range(60).select("id").withColumnRenamed("id", "attempt")
    kinds = lambda rows: {k: {(round(r.x, 3), round(r.y, 3)) for r in rows if r.kind == k and r.x is not None} for k in ("fire", "medical", "accident", "crime")}
    centres = [(4.0 * k + 1, 1.0) for k in range(4)]
    got = kinds(place_incidents(tries, *tables(spark, ("retail", "civic", "", "commercial")), 1).collect())
    assert got["fire"] == {centres[0], centres[3]} and got["crime"] == {centres[1], centres[3]} and got["medical"] == set(centres)
    assert all((y == 0 and 100 <= x <= 110) or (x == 110 and 0 <= y <= 10) for x, y in got["accident"]) and len(got["accident"]) > 5
    got = kinds(place_incidents(tries, *tables(spark, ("hut",), roads=False), 1).collect())
    assert all(v == {centres[0]} for v in got.values())
    bare = place_incidents(tries, *tables(spark), 1).collect()
    got = kinds(bare)
    assert not got["fire"] and not got["crime"] and all(x >= 100 for k in ("medical", "accident") for x, _ in got[k]) and len(bare) == 60
    assert all(r.x is None for r in place_incidents(tries, *tables(spark, roads=False), 1).collect())


def test_limit(spark):
    tries = spark.createDataFrame([(k, 10 * k, 35 if k % 3 else 1000) for k in range(200)], "attempt long, t long, open_sec long")
    buildings, ways, nodes = tables(spark, ("retail",))
    got = incident_generator(tries, buildings, ways, nodes, 2, 3).orderBy("incident_id").collect()
    open_, want = [], []
    for k in range(200):
        open_ = [e for e in open_ if e > 10 * k]
        if len(open_) < 3:
            open_.append(10 * k + (35 if k % 3 else 1000))
            want.append(k)
    assert [(r.incident_id, r.attempt) for r in got] == list(enumerate(want, 1))
    assert all(r.counts == COUNTS[r.kind] for r in got)
    assert incident_generator(tries.where("t < 0"), buildings, ways, nodes, 2).count() == 0
