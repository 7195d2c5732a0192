"""Registered queries over live data: streams joined to tables, sessions under a limit, signal holds, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from roadspark.operators import graph as G
from roadspark.operators import incidents as O
from roadspark.operators import mapbuild as M
from roadspark.operators import sessions as E
from roadspark.operators import signals as L
from roadspark.operators import telemetry as V
from roadspark.operators import timelines as I
from roadspark.operators import trips as T
from roadspark.plans import fixtures as X
from roadspark.plans.store import shared_dir
from roadspark.queries import query, r4
from roadspark.queries_more import _DRAW
from roadspark.queries_roads import ORACLE_SQL, QUERIES
from roadspark.streaming import live as W
from roadspark.streaming import sink as K
from roadspark.streaming import states as Z

__all__ = ["ORACLE_SQL", "QUERIES"]

EPOCH = 1704067200


ROWS_A_FILE = 250_000


def as_stream(df, last=None, order=None, files=1):
    """df, stored, as a stream that takes so many files at a time. last: rows of a file of their own, which comes after all others.

    order: a column in whose order the files come. A source takes files by the time they were written, and tasks that write at once
    end in any order; so ranges of the column are written one after the other, as many as keep a file below some ROWS_A_FILE rows.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/source-{uuid.uuid4().hex}"
    if order is None:
        df.write.parquet(path)
    else:
        ranges = max(6, -(-df.count() // ROWS_A_FILE))
        df.repartitionByRange(ranges, order).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(f"{path}-ranges")
        dealt = spark.read.schema(Y.StructType([*df.schema, Y.StructField("__part", Y.IntegerType())])).parquet(f"{path}-ranges")
        for part in sorted(r["__part"] for r in dealt.select("__part").distinct().collect()):
            dealt.where(F.col("__part") == part).select(df.columns).coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        last.select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def state_messages(s, d):
    """value: a message for each tick of the states, every tenth one delivered twice; a tenth of the vehicles are tracked."""
    tracked = "vehicle_id % 10 = 9"
    v = F.expr(f"""named_struct('id', IF({tracked}, -1000000 - vehicle_id, vehicle_id), 'x', dist, 'y', CAST(lane AS DOUBLE), 'h', 0.5D, 's', round(speed_mps * 3.6, 1), 'o', 0.0D, 'l', length_m, 'w', 1.8D, 'ty', vehicle_type,
        'em', IF(vehicle_type IN ('ambulance', 'firetruck', 'police'), 1, NULL), 'ep', IF(vehicle_type IN ('ambulance', 'firetruck', 'police'), 1 + vehicle_id % 2, NULL), 'stk', IF(speed_mps < 0.5D, 1, NULL), 'live', IF({tracked}, 1, NULL), 'vid', IF({tracked}, concat('FV-', vehicle_id), NULL))""")
    ticks = X.states(s, d).groupBy("t").agg(F.collect_list(v).alias("vehicles")).withColumn("t", F.col("t").cast("double"))
    once = ticks.select(F.to_json(F.struct("t", "vehicles")).alias("value"))
    return once.unionByName(ticks.where("t % 10 = 0").select(F.to_json(F.struct("t", "vehicles")).alias("value")))


def _manifest(s, d):
    return X.trips(s, d).selectExpr("trip_id AS id", "vehicle_type AS vehicleType", "start_node AS startNodeId", "end_node AS endNodeId", "CAST(3 + trip_id % 4 AS DOUBLE) AS length", "IF(trip_id % 7 >= 4, 'a_1', NULL) AS homeAmenityId")


def _joined(rows):
    return rows.select("t", "id", F.round("speed_kmh", 1).alias("speed_kmh"), "live_type", "emergency", "phase", "stuck", "tracked", "external_id", "vehicleType", "startNodeId", "endNodeId", "length", "homeAmenityId")


_JOINED = """SELECT t::DOUBLE AS t, CASE WHEN vehicle_id % 10 = 9 THEN -1000000 - vehicle_id ELSE vehicle_id END AS id, round(speed_mps * 3.6, 1) AS speed_kmh, st.vehicle_type AS live_type, st.vehicle_type IN ('ambulance', 'firetruck', 'police') AS emergency,
    CASE WHEN st.vehicle_type IN ('ambulance', 'firetruck', 'police') THEN 1 + vehicle_id % 2 END AS phase, speed_mps < 0.5 AS stuck, vehicle_id % 10 = 9 AS tracked, CASE WHEN vehicle_id % 10 = 9 THEN 'FV-' || vehicle_id END AS external_id,
    tr.vehicle_type AS "vehicleType", start_node AS "startNodeId", end_node AS "endNodeId", (3 + trip_id % 4)::DOUBLE AS length, CASE WHEN trip_id % 7 >= 4 THEN 'a_1' END AS "homeAmenityId"
    FROM st LEFT JOIN tr ON trip_id = vehicle_id AND vehicle_id % 10 <> 9"""


@query("stream_state_join", _JOINED)
def stream_state_join(s, d):
    """All ticks through a stream, joined to the trip manifest, rows appended as they come."""
    out = Z.stream_state_join(as_stream(state_messages(s, d).repartition(48), files=12), _manifest(s, d), EPOCH, "10 minutes")
    return _joined(W.run_once(out, shared_dir(s), "append"))


@query("batch_state_join", _JOINED)
def batch_state_join(s, d):
    return _joined(Z.stream_state_join(state_messages(s, d), _manifest(s, d), EPOCH))


CAP = 6

_CAPPED = f"""WITH e AS (SELECT 'g' || (user_id % 2) AS gate, 'FV-' || user_id AS v, event_id AS t, event_type = 'signup' AS rem FROM events),
    b AS (SELECT *, lag(t) OVER w AS pt, lag(rem) OVER w AS pr, lead(t) OVER w AS nt, lead(rem) OVER w AS nr FROM e WINDOW w AS (PARTITION BY v ORDER BY t)),
    f AS (SELECT *, sum(CASE WHEN pt IS NULL OR pr OR t - pt > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY t) AS s, CASE WHEN nr AND nt - t <= 20 THEN nt END AS gone FROM b WHERE NOT rem),
    o AS (SELECT gate, v, s, max(t) AS z, max(gone) AS gone FROM f GROUP BY ALL),
    k AS (SELECT f.gate, f.v, f.s, f.t, coalesce(o.gone - 1, o.z + 20) AS until, row_number() OVER (PARTITION BY f.gate ORDER BY f.t) AS i FROM f JOIN o USING (gate, v, s)),
    r(gate, i, act, ok) AS (SELECT DISTINCT gate, 0::BIGINT, []::STRUCT(v VARCHAR, u BIGINT)[], false FROM k
        UNION ALL SELECT gate, i, CASE WHEN known OR len(live) >= {CAP} THEN live ELSE list_append(live, {{'v': v, 'u': until::BIGINT}}) END, known OR len(live) < {CAP} FROM
        (SELECT *, list_contains(list_transform(live, lambda x: x.v), v) AS known FROM (SELECT k.gate, k.i, k.v, k.until, list_filter(r.act, lambda x: x.u >= k.t) AS live FROM r JOIN k ON k.gate = r.gate AND k.i = r.i + 1)))
    SELECT gate, v AS vehicle_id, min(CASE WHEN ok THEN t END) AS start, max(t) AS "end", count(*) FILTER (ok) AS fixes, count(*) FILTER (NOT ok) AS refused, CASE WHEN any_value(o.gone) IS NULL THEN 'timeout' ELSE 'remove' END AS reason
    FROM k JOIN r USING (gate, i) JOIN o USING (gate, v, s) GROUP BY gate, v, s"""


def _tracked(s, d):
    """gate, vehicle_id, t, kind of all events; signups stand for removals."""
    return s.read.parquet(f"{d}/events.parquet").selectExpr("concat('g', user_id % 2) AS gate", "concat('FV-', user_id) AS vehicle_id", "event_id AS t", "IF(event_type = 'signup', 'remove', 'fix') AS kind")


@query("capped_sessions", _CAPPED, recursive=True)
def capped_sessions(s, d):
    """Sessions of two gates that admit six vehicles at once."""
    return E.capped_sessions(_tracked(s, d), CAP)


@query("capped_session_stream", _CAPPED, recursive=True)
def capped_session_stream(s, d):
    """The same through a stream, which a last event far later brings to its end."""
    events = _tracked(s, d).selectExpr("gate", "vehicle_id", f"timestamp_seconds({EPOCH} + t) AS ts", "kind")
    last = s.createDataFrame([("", "", 4_000_000_000)], "gate string, vehicle_id string, t long").selectExpr("gate", "vehicle_id", "timestamp_seconds(t) AS ts", "'remove' AS kind")
    out = W.run_once(Z.capped_session_stream(as_stream(events, last, "ts"), CAP, lateness="1 day"), shared_dir(s), "append")
    seconds = lambda c: ((F.col(c) / 1000).cast("long") - EPOCH).alias(c)
    return out.select("gate", "vehicle_id", seconds("start"), seconds("end"), "fixes", "refused", "reason")


_FOLD = """WITH ev AS (SELECT event_id, 'n' || event_id % 20 AS node_id, 't' || user_id % 5 AS token, 'c' || user_id % 3 AS controller, event_type = 'purchase' OR (event_type = 'signup' AND event_id % 7 = 0) AS force, event_type = 'signup' AS rel,
        CASE WHEN event_id % 3 <> 0 THEN 'h' || event_id % 4 || CASE WHEN event_id % 2 = 0 THEN ':through' ELSE ':right' END WHEN event_id % 15 <> 0 THEN 'v' || event_id % 4 || ':right,v' || event_id % 4 || ':through' ELSE '' END AS lamps,
        row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS i FROM events WHERE event_type IN ('click', 'purchase', 'signup')),
    f(node_id, i, h, since, c, l) AS (SELECT DISTINCT node_id, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM ev UNION ALL
        SELECT node_id, i, CASE WHEN takes THEN token WHEN frees THEN NULL ELSE h END, CASE WHEN takes THEN CASE WHEN h = token THEN since ELSE event_id END WHEN frees THEN NULL ELSE since END, CASE WHEN takes THEN controller WHEN frees THEN NULL ELSE c END, CASE WHEN takes THEN lamps WHEN frees THEN NULL ELSE l END FROM
        (SELECT e.*, f.h, f.since, f.c, f.l, NOT rel AND (f.h IS NULL OR f.h = e.token OR e.force) AS takes, rel AND f.h IS NOT NULL AND (f.h = e.token OR e.force) AS frees FROM f JOIN ev e ON e.node_id = f.node_id AND e.i = f.i + 1)),
    j AS (SELECT e.*, a.h, a.since AS s0, a.c, a.l, b.h AS h1, b.since AS s1 FROM ev e JOIN f a ON a.node_id = e.node_id AND a.i = e.i - 1 JOIN f b ON b.node_id = e.node_id AND b.i = e.i),
    lg AS (SELECT node_id, 'rejected' AS what, token, controller, s0 AS since, event_id, lamps FROM j WHERE NOT rel AND h <> token AND NOT force
        UNION ALL SELECT node_id, 'end', h, c, s0, event_id, l FROM j WHERE h IS NOT NULL AND s1 IS DISTINCT FROM s0
        UNION ALL SELECT node_id, CASE WHEN s1 = event_id THEN 'begin' ELSE 'change' END, token, controller, s1, event_id, lamps FROM j WHERE NOT rel AND h1 = token AND (h IS NULL OR h = token OR force))"""


@query("override_holds", f"""{_FOLD} SELECT node_id, token, arg_max(controller, (event_id, what)) AS controller, since, max(event_id) FILTER (what = 'end') AS until, arg_max(lamps, (event_id, what)) AS lamps FROM lg WHERE what <> 'rejected' GROUP BY node_id, token, since""", recursive=True)
def override_holds(s, d):
    return L.override_holds(X.overrides(s, d))[0]


@query("override_rejections", f"{_FOLD} SELECT event_id, node_id, 'held by another' AS reason FROM lg WHERE what = 'rejected'", recursive=True)
def override_rejections(s, d):
    return L.override_holds(X.overrides(s, d))[1]


@query("override_stream", f"{_FOLD} SELECT * FROM lg", recursive=True)
def override_stream(s, d):
    """Every change of a hold as a stream gives it."""
    events = X.overrides(s, d).withColumn("ts", F.timestamp_seconds(F.col("event_id") + EPOCH))
    last = events.limit(1).selectExpr("1000000000L AS event_id", "'release' AS action", "false AS force", "'' AS node_id", "'' AS token", "'' AS controller", "CAST(NULL AS array<struct<wayId:string,movement:string>>) AS green_lamps", "CAST(NULL AS string) AS way_id", "timestamp_seconds(4000000000L) AS ts")
    return W.run_once(Z.override_stream(as_stream(events, last, "event_id"), "1 day"), shared_dir(s), "append")


@query("upsert_sink", "SELECT DISTINCT ON (vehicle_id) vehicle_id, t, x, y FROM fx ORDER BY vehicle_id, t DESC")
def upsert_sink(s, d):
    """The last fix of each vehicle, by a stream into a keyed table of 8 buckets."""
    fixes = X.fixes(s, d).select("vehicle_id", "t", "x", "y")
    where = f"{shared_dir(s)}/keyed-{uuid.uuid4().hex}"
    stream = as_stream(fixes.repartition(3)).writeStream.option("checkpointLocation", f"{where}/state")
    stream.foreachBatch(K.upsert_sink(f"{where}/table", "vehicle_id", "t", 8)).trigger(availableNow=True).start().awaitTermination()
    return K.read_keyed(s, f"{where}/table", "vehicle_id", "t", fixes.schema)


_SECONDS = f"""{_FOLD}, hd AS (SELECT node_id, event_id, arg_max(what <> 'end', what <> 'end') AS held, arg_max(lamps, what <> 'end') AS lamps FROM lg WHERE what <> 'rejected' GROUP BY node_id, event_id),
    gm AS (SELECT node_id, count(*) OVER (PARTITION BY r) AS n, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS i FROM sg WHERE r % 2 = 0),
    tk AS (SELECT node_id, t FROM sg, range(0, 1500) AS q(t)),
    st2 AS (SELECT tk.node_id, tk.t, coalesce(held, false) AS held, coalesce(lamps, '') AS lamps FROM tk ASOF LEFT JOIN hd ON hd.node_id = tk.node_id AND tk.t >= hd.event_id),
    ck AS (SELECT *, t - coalesce(sum(held::INT) OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM st2),
    own AS (SELECT ck.*, coalesce(n, 1) < 2 OR (c % (30 * n)) // 30 = i AS turn, CASE WHEN coalesce(n, 1) < 2 THEN c ELSE c % 30 END AS l FROM ck LEFT JOIN gm USING (node_id)),
    lp AS (SELECT node_id, paired, green, step, w, p, isa, m FROM sg, LATERAL (VALUES ('h' || r, 0, true), ('v' || col, 1, true), ('h' || r || 'w', 0, false), ('v' || col || 's', 1, false), ('none', -1, true)) AS v(w, p, isa), (VALUES ('through'), ('right')) AS z(m)),
    x AS (SELECT lp.*, own.t, held, list_contains(string_split(lamps, ','), w || ':' || m) AS lit, turn, l % (2 * (green + 5)) - p * (green + 5) AS o, l % (8 * step + 4) - p * (4 * step + 2) AS u,
        CASE WHEN m = 'right' THEN CASE WHEN isa THEN step ELSE 3 * step END ELSE CASE WHEN isa THEN 2 * step ELSE 0 END END AS rs, CASE WHEN m = 'right' THEN 3 * step ELSE step END AS rl FROM lp JOIN own USING (node_id) WHERE own.t >= 100),
    y AS (SELECT *, CASE WHEN held THEN CASE WHEN lit THEN 'green' ELSE 'red' END WHEN NOT turn OR p < 0 THEN 'red'
        WHEN paired THEN CASE WHEN u < 0 OR u >= 4 * step OR (u - rs + 8 * step) % (4 * step) < rl THEN 'red' WHEN 4 * step - (u - rs + 8 * step) % (4 * step) <= 3 THEN 'yellow' ELSE 'green' END
        ELSE CASE WHEN NOT isa OR o < 0 OR o >= green + 3 THEN 'red' WHEN o < green THEN 'green' ELSE 'yellow' END END AS color FROM x)
    SELECT node_id, w AS way_id, m AS movement, count(*) FILTER (color = 'green')::DOUBLE AS green_sec, count(*) FILTER (color = 'yellow')::DOUBLE AS yellow_sec, count(*) FILTER (color = 'red')::DOUBLE AS red_sec FROM y GROUP BY node_id, w, m"""


@query("lamp_seconds", _SECONDS, recursive=True)
def lamp_seconds(s, d):
    """Every lamp of every signal from second 100 to 1500: plans of both schemes, every other row's signals in turns, holds by all override events."""
    sig = X.signals(s, d)
    ways = F.explode(F.array(F.concat(F.lit("h"), "r"), F.concat(F.lit("v"), "col"), F.concat(F.lit("h"), "r", F.lit("w")), F.concat(F.lit("v"), "col", F.lit("s")), F.lit("none")))
    lamps = sig.select("node_id", ways.alias("way_id")).withColumn("movement", F.explode(F.array(F.lit("through"), F.lit("right"))))
    groups = X.signal_groups(s, d).where("CAST(substr(group_id, 2) AS INT) % 2 = 0")
    return I.lamp_seconds(sig, lamps, 100, 1500, groups, I.hold_pieces(X.overrides(s, d)))


@query("fresh_routes", """WITH ed AS (SELECT src, dst, way_id, seq, f, weight * 10 / greatest(2.0, CASE CAST(regexp_extract(src, '[0-9]+') AS INT) % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 ELSE 10.0 END)::DOUBLE AS c FROM edge),
    v AS (SELECT way_id, sum(c) FILTER (seq > 0) AS cur, max(dst) FILTER (seq = 0) AS src, arg_max(dst, seq) AS dst FROM ed WHERE f GROUP BY way_id HAVING max(seq) > 0),
    arc AS MATERIALIZED (SELECT src, dst, min(c) AS c FROM ed GROUP BY src, dst),
    r(v, n, c) USING KEY (v, n) AS (SELECT way_id, src, 0.0::DOUBLE FROM v UNION SELECT x.v, x.n, x.c FROM (SELECT r.v, arc.dst AS n, min(r.c + arc.c) AS c FROM r JOIN arc ON arc.src = r.n JOIN v ON v.way_id = r.v WHERE r.c + arc.c < 0.85 * cur GROUP BY r.v, arc.dst) x
        LEFT JOIN recurring.r q ON q.v = x.v AND q.n = x.n WHERE q.c IS NULL OR x.c < q.c)
    SELECT way_id AS vehicle_id, round(cur, 4) AS current_sec, round(c, 4) AS new_sec, c IS NOT NULL AS switch FROM v LEFT JOIN r ON r.v = v.way_id AND n = dst""", recursive=True)
def fresh_routes(s, d):
    """A vehicle at the beginning of every way that may be driven forward, bound for its end, with a third of all edges slow."""
    all_edges = G.routing_edges(X.nodes(s, d), X.ways(s, d))
    edges = all_edges.selectExpr("concat(src, '>', dst) AS edge_id", "src", "dst", "weight_sec * 10 AS length_m", "10.0D AS speed_mps")
    live = edges.selectExpr("edge_id", "CASE CAST(regexp_extract(src, '[0-9]+', 0) AS INT) % 6 WHEN 0 THEN 1.0D WHEN 1 THEN 3.0D END AS live_mps").where("live_mps IS NOT NULL")
    ways = M.routable_ways(X.ways(s, d), X.nodes(s, d)).where("coalesce(tags['oneway'], '') <> '-1'")
    twin = "IF(tags['divider'] = 'yes' AND tags['oneway'] IS NULL AND {0} > 0 AND {0} < size(nodes) - 1, '#fwd', '')"
    steps = ways.selectExpr("*", "explode(sequence(0, size(nodes) - 2)) AS step").selectExpr("way_id AS vehicle_id", "step", f"concat(nodes[step], {twin.format('step')}, '>', nodes[step + 1], {twin.format('(step + 1)')}) AS edge_id", "false AS is_junction")
    vehicles = ways.where("size(nodes) > 2").selectExpr("way_id AS vehicle_id", "0 AS step", "element_at(nodes, -1) AS dest_node", "false AS emergency", "false AS tracked")
    return V.fresh_routes(vehicles, steps, edges, live, hops=6).select("vehicle_id", *r4("current_sec", "new_sec"), "switch")


_PLACED_AT = f"""WITH tries AS (SELECT event_id AS attempt, 120 * (event_id + 1) AS t, 300 + (event_id * 7919) % 2700 AS open_sec FROM events),
    pool AS (SELECT 'any' AS pool, building_id, cx, cy FROM bl UNION ALL SELECT 'fire', building_id, cx, cy FROM bl WHERE building IN ('residential', 'commercial', 'industrial', 'retail') UNION ALL SELECT 'crime', building_id, cx, cy FROM bl WHERE building IN ('civic', 'commercial')),
    rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY building_id) - 1 AS idx, count(*) OVER (PARTITION BY pool) AS n FROM pool),
    rd AS (SELECT way_id, max(n) AS n, row_number() OVER (ORDER BY way_id) - 1 AS idx, count(*) OVER () AS m FROM wn GROUP BY way_id),
    kd AS (SELECT *, (['fire', 'medical', 'accident', 'crime'])[CAST(({_DRAW.format(s=5, a='attempt', b=0, c=0)}) * 4 // 2147483648 AS INT) + 1] AS kind, {_DRAW.format(s=5, a='attempt', b=1, c=0)} AS u1, {_DRAW.format(s=5, a='attempt', b=2, c=0)} AS u2, {_DRAW.format(s=5, a='attempt', b=3, c=0)} AS u3 FROM tries),
    pl AS (SELECT attempt, t, open_sec, kind, cx AS x, cy AS y FROM kd JOIN rk ON rk.pool = CASE kind WHEN 'fire' THEN 'fire' ELSE 'any' END AND rk.idx = u1 * n // 2147483648 WHERE kind <> 'accident'
        UNION ALL SELECT attempt, t, open_sec, kind, a.x + (b.x - a.x) * (u3 / 2147483648.0::DOUBLE), a.y + (b.y - a.y) * (u3 / 2147483648.0::DOUBLE) FROM kd JOIN rd ON rd.idx = u1 * m // 2147483648 JOIN wn a ON a.way_id = rd.way_id AND a.seq = u2 * (rd.n - 1) // 2147483648 JOIN wn b ON b.way_id = rd.way_id AND b.seq = a.seq + 1 WHERE kind = 'accident'),
    k AS (SELECT *, row_number() OVER (ORDER BY t) AS i FROM pl),
    r(i, act, ok) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT i, CASE WHEN len(live) < 8 THEN list_append(live, (t + open_sec)::BIGINT) ELSE live END, len(live) < 8 FROM (SELECT k.i, k.t, k.open_sec, list_filter(r.act, lambda u: u > k.t) AS live FROM r JOIN k ON k.i = r.i + 1))"""


@query("incident_generator", f"{_PLACED_AT} SELECT row_number() OVER (ORDER BY t) AS incident_id, attempt, t, kind, round(x, 6) AS x, round(y, 6) AS y, CASE kind WHEN 'fire' THEN 'ambulance=1,firetruck=2' WHEN 'medical' THEN 'ambulance=1' WHEN 'accident' THEN 'ambulance=1,police=1' ELSE 'police=2' END AS counts FROM k JOIN r USING (i) WHERE ok", recursive=True)
def incident_generator(s, d):
    """An attempt every two minutes for each event; incidents stay open for 5 to 50 minutes."""
    attempts = s.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS attempt", "120 * (event_id + 1) AS t", "300 + (event_id * 7919) % 2700 AS open_sec")
    made = O.incident_generator(attempts, X.buildings(s, d), X.ways(s, d), X.nodes(s, d), 5)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return made.select("incident_id", "attempt", "t", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), counts.alias("counts"))


@query("lane_change_safe", """WITH n AS (SELECT t, vehicle_id, dist, lead(dist) OVER w AS d1, lead(vehicle_id) OVER w AS v1, lag(dist) OVER w AS d0, lag(vehicle_id) OVER w AS v0 FROM st WINDOW w AS (PARTITION BY t, edge, lane ORDER BY dist, vehicle_id))
    SELECT t, vehicle_id, (d1 IS NULL OR d1 - 4.5 - dist >= CASE WHEN v1 % 7 IN (2, 3, 5) THEN 7.5 ELSE 5 END) AND (d0 IS NULL OR dist - 4.5 - d0 >= CASE WHEN v0 % 7 IN (2, 3, 5) THEN 9 ELSE 6 END) AS safe FROM n""")
def lane_change_safe(s, d):
    """Every vehicle at every tick against its neighbours; buses, trucks and fire engines are wide."""
    wide = lambda c: F.when(F.col(c) % 7 == 2, 2.5).when(F.col(c) % 7 == 3, 2.5).when(F.col(c) % 7 == 5, 2.5).when(F.col(c).isNotNull(), 1.8)
    return V.lane_change_safe(V.lane_neighbors(X.states(s, d)).withColumns({"ahead_width": wide("ahead_id"), "behind_width": wide("behind_id")}))


def _fleets(s, d):
    """Amenities with up to two fleets of up to three vehicles; some vehicles are in several."""
    vehicle = "named_struct('id', concat('v', (s_suppkey * 7 + f * 3 + i) % 60), 'length', CAST(4 + i AS DOUBLE), 'maxSpeed', CAST(80 + 10 * f AS DOUBLE))"
    fleet = f"named_struct('id', concat('f', s_suppkey, '_', f), 'vehicleType', IF(f = 0, 'police', 'ambulance'), 'vehicles', transform(filter(sequence(0, 2), i -> i < (s_suppkey + f) % 4), i -> {vehicle}))"
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('a_', s_suppkey) AS amenity_id", f"transform(filter(sequence(0, 1), f -> f < s_suppkey % 3), f -> {fleet}) AS fleets")


_FLEETS = """WITH a AS (SELECT s_suppkey AS s FROM supplier), f AS (SELECT s, f FROM a LEFT JOIN range(0, 2) AS q(f) ON f < s % 3), v AS (SELECT s, f, i FROM f LEFT JOIN range(0, 3) AS z(i) ON i < (s + f) % 4),
    r AS (SELECT 'a_' || s AS amenity_id, 'f' || s || '_' || f AS fleet_id, CASE f WHEN 0 THEN 'police' WHEN 1 THEN 'ambulance' END AS vehicle_type, 'v' || ((s * 7 + f * 3 + i) % 60) AS vehicle_id, (4 + i)::DOUBLE AS length, CASE WHEN i IS NOT NULL THEN (80 + 10 * f)::DOUBLE END AS max_speed FROM v)"""


@query("fleet_vehicles", f"{_FLEETS} SELECT * FROM r")
def fleet_vehicles(s, d):
    return T.fleet_vehicles(_fleets(s, d))[0].withColumnRenamed("maxSpeed", "max_speed")


@query("fleet_duplicates", f"{_FLEETS} SELECT vehicle_id, count(*) AS n FROM r WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id HAVING count(*) > 1")
def fleet_duplicates(s, d):
    return T.fleet_vehicles(_fleets(s, d))[1]
