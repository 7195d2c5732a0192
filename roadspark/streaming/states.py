"""Streams that are joined or folded: live states with their trips, sessions with removals and a limit, signal holds.

Folds are keyed state machines: events wait in the state until the watermark has passed them, so that they are taken in
the order of event time whatever the order of arrival, and the rows are those of the batch forms.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadspark.functions import constants as C
from roadspark.operators.sessions import MOST_LIVE
from roadspark.operators.signals import lamps_of

VEHICLE = "struct<id:long,x:double,y:double,h:double,s:double,o:double,l:double,w:double,ty:string,aw:double,em:int,ep:int,stk:int,live:int,vid:string>"


def stream_state_join(raw: DataFrame, trips: DataFrame, epoch: int = 0, lateness: str = "1 minute") -> DataFrame:
    """A row per vehicle and tick: what is live about it, and what the trip manifest says of it (nulls for tracked vehicles).

    raw: value, a state message each, as a stream or a table; a message that comes twice counts once, by its t, as long as the
    watermark (t seconds after epoch, lateness) remembers it. trips: id and attributes, a static table that is joined to each
    micro-batch; of an id that occurs twice the row with the least attributes counts. Messages without a t are left out.
    """
    # a message's vehicles are read behind the shuffle that finds its twin: a source's few files would be read by as few tasks
    m = raw.select("value", F.from_json("value", "t double")["t"].alias("t")).where("t IS NOT NULL")
    once = m.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + epoch * 1_000_000)).withWatermark("ts", lateness).dropDuplicates(["ts"])
    flag = lambda c: F.coalesce(F.col(f"v.{c}") == 1, F.lit(False))
    live = once.select("t", "ts", F.explode(F.from_json("value", f"t double, vehicles array<{VEHICLE}>")["vehicles"]).alias("v")).select(
        "t", "ts", "v.id", "v.x", "v.y", F.col("v.h").alias("heading_rad"), F.col("v.s").alias("speed_kmh"), F.col("v.o").alias("lateral_m"), F.col("v.l").alias("live_length"), F.col("v.w").alias("live_width"),
        F.col("v.ty").alias("live_type"), F.col("v.aw").alias("queued_sec"), flag("em").alias("emergency"), F.col("v.ep").alias("phase"), flag("stk").alias("stuck"), flag("live").alias("tracked"), F.col("v.vid").alias("external_id"),
    )
    attributes = [c for c in trips.columns if c != "id"]
    manifest = trips.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct(*attributes)).alias("a")).select("id", "a.*")
    return live.join(manifest, "id", "left")


def in_order(step: Callable, finish: Callable, columns: list[str], schema: str):
    """A state function that hands a key's events to `step` in the order of ts once the watermark has passed them.

    step(memory, event) and finish(memory, watermark) give rows (lists) and change memory, a dict that JSON can hold; finish
    may set memory["wake"] to a time (ms) at which it wants to be asked again. Events wait as rows of `columns`, ts in ms;
    rows of schema come out, the key first.
    """

    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, waiting = (json.loads(x) for x in state.get) if state.exists else ({}, [])
        for pdf in parts:
            pdf = pdf.assign(ts=pdf["ts"].astype("datetime64[ms]").astype("int64"))
            waiting += pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda e: [(x is not None, x) for x in e])
        due = [e for e in waiting if e[0] < mark]
        waiting = waiting[len(due) :]
        rows = [r for e in due for r in step(memory, dict(zip(columns, e, strict=True)))]
        rows += finish(memory, mark)
        wake = min([x for x in (memory.get("wake"), waiting[0][0] if waiting else None) if x is not None], default=None)
        if wake is None and not memory:
            state.remove()
        else:
            state.update((json.dumps(memory), json.dumps(waiting)))
            if wake is not None:
                state.setTimeoutTimestamp(max(int(wake), mark) + 1)
        yield pd.DataFrame([[*key, *r] for r in rows], columns=names, dtype=object)

    return run


def _folded(events: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return events.groupBy(*keys).applyInPandasWithState(run, schema, "memory string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def capped_session_stream(events: DataFrame, cap: int = MOST_LIVE, timeout_sec: float = C.LIVE_TIMEOUT_SEC, lateness: str = "1 minute") -> DataFrame:
    """gate, vehicle_id, start, end, fixes, refused, reason (in ms): sessions.capped_sessions over a stream.

    events: gate, vehicle_id, ts, kind (fix or remove). A session comes out when the watermark shows that it has ended; one that was
    never admitted comes out with a null start. A gate's state holds its open sessions and what the watermark hasn't passed.
    """
    wait = int(timeout_sec * 1000)

    def close(memory: dict, vehicle: str, reason: str) -> list:
        s = memory["open"].pop(vehicle)
        return [vehicle, s["start"], s["last"], s["fixes"], s["refused"], reason]

    def expire(memory: dict, now: float) -> list:
        """Sessions without a fix for longer than the limit at now."""
        return [close(memory, v, "timeout") for v in sorted(v for v, s in memory.get("open", {}).items() if now - s["last"] > wait)]

    def step(memory: dict, e: dict) -> list:
        out, now = expire(memory, e["ts"]), e["ts"]
        sessions = memory.setdefault("open", {})
        if e["rank"] == 0:
            return out + ([close(memory, e["vehicle_id"], "remove")] if e["vehicle_id"] in sessions else [])
        s = sessions.setdefault(e["vehicle_id"], {"start": None, "fixes": 0, "refused": 0})
        s["last"] = now
        if s["start"] is None and sum(x["start"] is not None for x in sessions.values()) < cap:
            s["start"] = now
        s["refused" if s["start"] is None else "fixes"] += 1
        return out

    def finish(memory: dict, mark: int) -> list:
        out = expire(memory, mark)
        if memory.get("open"):
            memory["wake"] = min(s["last"] for s in memory["open"].values()) + wait + 1
        else:
            memory.clear()
        return out

    ranked = events.withColumn("rank", F.when(F.col("kind") == "remove", 0).otherwise(1)).select("gate", "ts", "rank", "vehicle_id").withWatermark("ts", lateness)
    schema = "gate string, vehicle_id string, start long, end long, fixes long, refused long, reason string"
    return _folded(ranked, ["gate"], in_order(step, finish, ["ts", "rank", "vehicle_id"], schema), schema)


def override_stream(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """node_id, what (begin, change, end, rejected), token, controller, since, event_id, lamps: signals.override_log as it happens.

    events: event_id, ts, action (override, release), node_id, token, controller, force, green_lamps, way_id. A row comes out for each event that begins, changes or ends a hold, or that is rejected. Events of one instant go by event_id.
    """

    def step(memory: dict, e: dict) -> list:
        held, at = memory.get("held"), e["event_id"]
        mine = held is not None and held["token"] == e["token"]
        if e["action"] == "override":
            if held is not None and not mine and not e["force"]:
                return [["rejected", e["token"], e["controller"], held["since"], at, e["lamps"]]]
            out = [["end", held["token"], held["controller"], held["since"], at, held["lamps"]]] if held is not None and not mine else []
            memory["held"] = {"token": e["token"], "controller": e["controller"], "since": held["since"] if mine else at, "lamps": e["lamps"]}
            return [*out, ["change" if mine else "begin", e["token"], e["controller"], memory["held"]["since"], at, e["lamps"]]]
        if held is not None and (mine or e["force"]):
            memory.clear()
            return [["end", held["token"], held["controller"], held["since"], at, held["lamps"]]]
        return []

    columns = ["ts", "event_id", "action", "token", "controller", "force", "lamps"]
    rows = events.withColumn("lamps", lamps_of(F.col("green_lamps"), F.col("way_id"))).select("node_id", *columns).withWatermark("ts", lateness)
    schema = "node_id string, what string, token string, controller string, since long, event_id long, lamps string"
    return _folded(rows, ["node_id"], in_order(step, lambda memory, mark: [], columns, schema), schema)
