"""Streams of fixes and states: latest position, sessions, windows per edge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import constants as C


def latest_position_stream(fixes: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """vehicle_id with the newest fix by event time; later ones replace it, late ones don't. fixes has ts."""
    return fixes.withWatermark("ts", lateness).groupBy("vehicle_id").agg(F.max_by(F.struct("ts", "x", "y"), "ts").alias("f")).select("vehicle_id", "f.ts", "f.x", "f.y")


def live_session_stream(fixes: DataFrame, timeout_sec: float = C.LIVE_TIMEOUT_SEC, lateness: str = "1 minute") -> DataFrame:
    """vehicle_id, start, end, fixes: sessions end after more than timeout_sec without a fix, so the gap is a microsecond wider."""
    gap = f"{int(timeout_sec * 1_000_000) + 1} microseconds"
    grouped = fixes.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "vehicle_id")
    return grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("fixes")).select("vehicle_id", "start", "end", "fixes")


def edge_window_stream(states: DataFrame, size: str, slide: str | None = None, lateness: str = "1 minute") -> DataFrame:
    """edge, start, n, avg_mps in tumbling (or sliding) windows over event time ts."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return states.withWatermark("ts", lateness).groupBy(w.alias("w"), "edge").agg(F.count(F.lit(1)).alias("n"), F.avg("speed_mps").alias("avg_mps")).select("edge", F.col("w.start").alias("start"), "n", "avg_mps")


def run_once(stream: DataFrame, where: str, mode: str = "complete") -> DataFrame:
    """All that is there now through a streaming query into the folder `where`; its last result as a table."""
    spark: SparkSession = stream.sparkSession
    run = f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out" if mode == "complete" else f"{run}/out/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/out").select(*stream.columns)
