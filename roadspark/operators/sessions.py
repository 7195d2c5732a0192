"""Sessions of tracked vehicles with removals, and at most so many at once per gate."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import constants as C
from roadspark.plans.store import running_total, stored

MOST_LIVE = 64  # fixed value: tracked vehicles at once

_SESSION = ["gate", "vehicle_id", "session"]


def _raw(events: DataFrame, timeout: float) -> tuple[DataFrame, DataFrame]:
    """(fixes with their session, sessions) as if there were no limit."""
    w = Window.partitionBy("gate", "vehicle_id").orderBy("t", "rank")
    ranked = events.select("gate", "vehicle_id", "t", F.when(F.col("kind") == "remove", 0).otherwise(1).alias("rank"))
    seen = ranked.withColumns({"before": F.lag(F.struct("t", "rank")).over(w), "after": F.lead(F.struct("t", "rank")).over(w)}).where("rank = 1")
    fresh = F.coalesce((F.col("before.rank") == 0) | (F.col("t") - F.col("before.t") > timeout), F.lit(True))
    ended = F.when((F.col("after.rank") == 0) & (F.col("after.t") - F.col("t") <= timeout), F.col("after.t"))
    fixes = seen.withColumn("session", F.sum(fresh.cast("long")).over(w)).select(*_SESSION, "t", ended.alias("removed_at"))
    sessions = fixes.groupBy(*_SESSION).agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"), F.max("removed_at").alias("removed_at"))
    return fixes, sessions.withColumns({"until": F.coalesce("removed_at", F.col("last") + timeout), "removed": F.col("removed_at").isNotNull()}).drop("removed_at")


def _contended(sessions: DataFrame, cap: int) -> DataFrame:
    """gate, vehicle_id, session, island: the sessions of stretches in which more than cap of a gate overlap.

    An island is a stretch without a moment at which its gate has no session. Islands and their peaks come from running
    totals over all beginnings and ends; at one moment removals come first, then beginnings, then ends by time.
    """
    begin = F.struct(F.col("start").alias("at"), F.lit(1).alias("turn"), F.lit(1).cast("long").alias("delta"))
    end = F.struct(F.col("until").alias("at"), F.when(F.col("removed"), 0).otherwise(2).alias("turn"), F.lit(-1).cast("long").alias("delta"))
    marks = sessions.select(*_SESSION, F.explode(F.array(begin, end)).alias("m")).select(*_SESSION, "m.*")
    key = ["gate", "at", "turn", "vehicle_id", "session"]
    counted = running_total(marks, *key, weight="delta", name="open").withColumn("first", ((F.col("delta") == 1) & (F.col("open") == 0)).cast("long"))
    begun = running_total(counted, *key, weight="first", name="islands").where("delta = 1").withColumn("island", F.col("islands") + F.col("first"))
    islands = stored(begun.select(*_SESSION, "island", "open"), "islands")
    full = islands.groupBy("island").agg(F.max("open").alias("most")).where(F.col("most") >= cap).select("island")
    return islands.join(full, "island").select(*_SESSION, "island")


def _sweep(cap: int):
    """Fixes in order (gate, island, t, vehicle_id, session, until, removed) -> the first admitted fix of each session. Its memory is cap sessions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, ends, admitted = None, [], set()
        for pdf in parts:
            took = []
            for gate, island, t, vehicle, session, until, removed in pdf.itertuples(index=False):
                if island != where:
                    where, ends, admitted = island, [], set()
                # a slot is free once its session's time has passed, or at the moment of a removal
                while ends and (ends[0][0] < t or (ends[0][0] == t and not ends[0][1])):
                    admitted.discard(heapq.heappop(ends)[2:])
                if (vehicle, session) not in admitted and len(ends) < cap:
                    admitted.add((vehicle, session))
                    heapq.heappush(ends, (until, not removed, vehicle, session))
                    took.append((gate, vehicle, session, t))
            yield pd.DataFrame(took, columns=[*_SESSION, "admitted"])

    return run


def _swept(fixes: DataFrame, cap: int) -> DataFrame:
    """gate, vehicle_id, session, admitted of the sessions that get in. fixes: of contended stretches, with island, until, removed."""
    ordered = fixes.repartition("island").sortWithinPartitions("island", "t", "vehicle_id").select("gate", "island", "t", "vehicle_id", "session", "until", "removed")
    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema}
    return ordered.mapInPandas(_sweep(cap), f"gate {kinds['gate']}, vehicle_id {kinds['vehicle_id']}, session long, admitted {kinds['t']}")


def admitted_spans(spans: DataFrame, cap: int) -> DataFrame:
    """Of spans (gate, vehicle_id, session, start, until, removed), stored, those that begin while fewer than cap admitted ones are open."""
    contended = stored(_contended(spans, cap).join(spans.select(*_SESSION, F.col("start").alias("t"), "until", "removed"), _SESSION), "contended")
    return spans.join(contended, _SESSION, "left_anti").select(*_SESSION).unionByName(_swept(contended, cap).select(*_SESSION))


def capped_sessions(events: DataFrame, cap: int = MOST_LIVE, timeout: float = C.LIVE_TIMEOUT_SEC) -> DataFrame:
    """gate, vehicle_id, start, end, fixes, refused, reason (remove or timeout): sessions under a limit of cap at once per gate.

    events: gate, vehicle_id, t, kind (fix or remove). A session lasts until no fix came for longer than timeout, or until a remove; end is
    its last fix. A fix of a vehicle without a session is refused while cap others are open; its next fix tries again, and
    a session that no fix of which was admitted has a null start. At one time removals go first, then vehicles by id.

    Sessions without the limit are windows per vehicle. Where no more than cap of them overlap they stand as they are; only
    stretches with more are swept in order, each by one task that remembers cap sessions.
    """
    fixes, raw = _raw(events, timeout)
    fixes, raw = stored(fixes, "fixes"), stored(raw, "sessions")
    swept = stored(fixes.join(_contended(raw, cap), _SESSION).join(raw.select(*_SESSION, "until", "removed"), _SESSION), "contended")
    admitted = _swept(swept, cap)
    counted = swept.join(admitted, _SESSION, "left").groupBy(*_SESSION).agg(F.min("admitted").alias("admitted"), F.count(F.when(F.col("t") >= F.col("admitted"), 1)).alias("fixes")).withColumn("swept", F.lit(True))
    out = raw.join(counted, _SESSION, "left")
    free = F.col("swept").isNull()
    n = F.when(free, F.col("n")).otherwise(F.col("fixes"))
    return out.select("gate", "vehicle_id", F.when(free, F.col("start")).otherwise(F.col("admitted")).alias("start"), F.col("last").alias("end"), n.alias("fixes"), (F.col("n") - n).alias("refused"), F.when(F.col("removed"), "remove").otherwise("timeout").alias("reason"))
