"""Streams against their batch forms and a sequential sweep: limits, removals, hot gates, late and repeated messages."""

import json
import random

from pyspark.sql import functions as F

from roadspark.operators.sessions import capped_sessions
from roadspark.operators.signals import override_log
from roadspark.plans.store import shared_dir
from roadspark.queries_live import as_stream
from roadspark.streaming import states as Z
from roadspark.streaming.live import run_once


def swept(events, cap, timeout=20):
    """One event after the other."""
    out, live, tries = [], {}, {}

    def close(key, reason):
        s = live.pop(key)
        out.append((*key, s["start"], s["last"], s["fixes"], s["refused"], reason))

    for gate, v, t, kind in sorted(events, key=lambda e: (e[2], e[3] != "remove", e[1])):
        for key in [k for k, s in live.items() if t - s["last"] > timeout]:
            close(key, "timeout")
        if kind == "remove":
            if (gate, v) in live:
                close((gate, v), "remove")
            continue
        s = live.setdefault((gate, v), {"start": None, "fixes": 0, "refused": 0})
        s["last"] = t
        if s["start"] is None and sum(x["start"] is not None for (g, _), x in live.items() if g == gate) < cap:
            s["start"] = t
        s["refused" if s["start"] is None else "fixes"] += 1
    for key in list(live):
        close(key, "timeout")
    return sorted(out, key=str)


def traffic(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        gate = rng.choice(["hot", "hot", "calm"])
        rows.append((gate, f"{gate}{rng.randrange(120 if gate == 'hot' else 4)}", rng.randrange(400 if gate == "hot" else 4000), rng.choice(["fix"] * 9 + ["remove"])))
    return list({(g, v, t): (g, v, t, k) for g, v, t, k in rows}.values())


def test_the_65th_is_refused_until_one_ends(spark):
    rows = [("g", f"v{k:02}", 0, "fix") for k in range(65)] + [("g", f"v{k:02}", 15, "fix") for k in range(65)] + [("g", "v03", 18, "remove"), ("g", "v64", 18, "fix")]
    got = {r.vehicle_id: r for r in capped_sessions(spark.createDataFrame(rows, "gate string, vehicle_id string, t long, kind string")).collect()}
    assert (got["v64"].start, got["v64"].fixes, got["v64"].refused) == (18, 1, 2) and got["v03"].reason == "remove"
    assert all((r.start, r.fixes, r.refused) == (0, 2, 0) for v, r in got.items() if v != "v64")


def test_batch_and_stream_are_the_sequential_sweep(spark):
    for seed, cap in ((1, 5), (2, 20)):
        rows = traffic(seed)
        want = swept(rows, cap)
        assert any(r[2] is None for r in want) and any(r[5] and r[2] is not None for r in want)
        df = spark.createDataFrame(rows, "gate string, vehicle_id string, t long, kind string").repartition(3)
        assert sorted((tuple(r) for r in capped_sessions(df, cap).collect()), key=str) == want
        base = 1_700_000_000
        timed = df.selectExpr("gate", "vehicle_id", f"timestamp_seconds({base} + t) AS ts", "kind")  # files hold times in disorder
        last = spark.createDataFrame([("", "", "remove")], "gate string, vehicle_id string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(4_000_000_000)))
        out = run_once(Z.capped_session_stream(as_stream(timed, last), cap, lateness="2 hours"), shared_dir(spark), "append")
        ms = lambda x: None if x is None else x // 1000 - base
        assert sorted(((r.gate, r.vehicle_id, ms(r.start), ms(r.end), r.fixes, r.refused, r.reason) for r in out.collect()), key=str) == want


def test_no_sessions(spark):
    none = spark.createDataFrame([], "gate string, vehicle_id string, t long, kind string")
    assert capped_sessions(none).count() == 0
    assert capped_sessions(spark.createDataFrame([("g", "v", 1, "remove")], none.schema)).count() == 0


def test_override_log(spark):
    schema = "event_id long, action string, node_id string, token string, controller string, force boolean, green_lamps array<struct<wayId:string,movement:string>>, way_id string"
    rows = [
        (1, "override", "n", "a", "A", None, None, "w1"), (2, "override", "n", "a", "A", None, [(" w2 ", "right")], "w9"), (3, "override", "n", "b", "B", False, [], None),
        (4, "release", "n", "b", "B", False, None, None), (5, "release", "n", "b", "B", True, None, None), (6, "override", "n", "b", None, False, None, " "), (7, "override", "n", "c", "C", True, None, None), (8, "release_all", "n", "", "", None, None, None),
    ]
    log = [tuple(r)[1:] for r in override_log(spark.createDataFrame(rows, schema)).orderBy("event_id", F.col("what") != "end").collect()]
    assert log == [
        ("begin", "a", "A", 1, 1, "w1:right,w1:through"), ("change", "a", "A", 1, 2, "w2:right"), ("rejected", "b", "B", 1, 3, ""), ("end", "a", "A", 1, 5, "w2:right"),
        ("begin", "b", "unknown", 6, 6, ""), ("end", "b", "unknown", 6, 7, ""), ("begin", "c", "C", 7, 7, ""), ("end", "c", "C", 7, 8, ""),
    ]


def test_state_join_takes_each_tick_once(spark):
    v = lambda i, **more: {"id": i, "x": 1.0, "s": 36.0, "ty": "car"} | more
    ticks = [{"t": t / 4, "vehicles": [v(1), v(2, stk=1), v(-1000000, live=1, vid="FV-1")]} for t in range(8)]
    raw = spark.createDataFrame([(json.dumps(t),) for t in [*ticks, *ticks[2:5], {"vehicles": []}, {"t": 9.0, "vehicles": []}]] + [("not json",), (None,)], "value string").repartition(3)
    trips = spark.createDataFrame([(1, "bus", 3.0), (3, "car", 4.0), (1, "car", 9.0)], "id int, vehicleType string, length double")
    batch = Z.stream_state_join(raw, trips)
    stream = run_once(Z.stream_state_join(as_stream(raw), trips, 1_700_000_000, "1 hour"), shared_dir(spark), "append")
    rows = lambda df: sorted(tuple(r) for r in df.select("t", "id", "speed_kmh", "stuck", "tracked", F.coalesce("external_id", F.lit("-")), F.coalesce("vehicleType", F.lit("-")), F.coalesce("length", F.lit(0.0))).collect())
    assert rows(batch) == rows(stream) and len(rows(batch)) == 24
    assert rows(batch)[:3] == [(0.0, -1000000, 36.0, False, True, "FV-1", "-", 0.0), (0.0, 1, 36.0, False, False, "-", "bus", 3.0), (0.0, 2, 36.0, True, False, "-", "-", 0.0)]
