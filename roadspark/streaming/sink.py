"""A keyed table that micro-batches add to: each batch writes its own rows, buckets are merged when their additions outweigh them.

Layout under a path: rows/epoch=E/bucket=B holds what batch E brought, whole/epoch=E/bucket=B a bucket merged at E, and
manifest/epoch=E the live parts: (bucket, part, epoch, rows). A batch becomes visible with its manifest, the last thing it
writes, so a batch that is repeated after a failure starts from the manifest before it and replaces only its own files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class Part(NamedTuple):
    """A live part of a bucket: `whole` or `rows`, written by batch epoch."""

    bucket: int
    part: str
    epoch: int
    rows: int


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The batches whose manifests are complete."""
    fs, where = _path(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in names if fs.exists(_path(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _manifest(spark: SparkSession, path: str, epoch: int) -> list[Part]:
    """One row per live part: a few per bucket, however large the table."""
    return [Part(*r) for r in spark.read.parquet(f"{path}/manifest/epoch={epoch}").select(*Part._fields).collect()]


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest (order, __epoch)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "__epoch")).alias("r")).select("r.*")


def _live(spark: SparkSession, path: str, parts: list[Part], schema: StructType) -> DataFrame:
    """The rows of the given parts, with __epoch; no other bucket's files are looked at."""
    files = [f"{path}/{p.part}/epoch={p.epoch}/__bucket={p.bucket}" for p in parts]
    wide = StructType([*schema.fields, StructField("__epoch", LongType())])
    return spark.read.schema(wide).parquet(*files) if files else spark.createDataFrame([], wide)


def _put(rows: DataFrame, path: str, part: str, epoch: int) -> list[Part]:
    """rows (with __bucket) as a part of each of their buckets, in place of what this batch wrote there before."""
    where = f"{path}/{part}/epoch={epoch}"
    rows.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(where)
    fs, at = _path(rows.sparkSession, where)
    if not any(s.isDirectory() for s in fs.listStatus(at)):
        return []
    counts = rows.sparkSession.read.parquet(where).groupBy("__bucket").count().collect()
    return [Part(int(r[0]), part, epoch, r[1]) for r in counts]


def outweighed(parts: list[Part]) -> list[Part]:
    """Those of a bucket's parts that are to be merged: from the largest one on that the smaller ones together are no smaller than."""
    parts = sorted(parts, key=lambda p: (-p.rows, p.epoch))
    for k in range(len(parts) - 1):
        if sum(p.rows for p in parts[k + 1 :]) >= parts[k].rows:
            return parts[k:]
    return []


def upsert_sink(path: str, key: str, order: str, buckets: int = 64):
    """A foreachBatch function that adds each batch to a keyed table; of a key the row with the greatest order counts, later batches first.

    A batch is written once, dealt into the buckets that its keys hash to. Where a bucket's smaller parts together are no smaller than a
    larger one, these are merged, so a bucket has as many parts as its rows have binary digits, and a row is
    rewritten as often at most: bytes written are in proportion to the batches, not to the table. Null keys are a key.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        earlier = [e for e in _epochs(spark, path) if e < epoch]
        before = _manifest(spark, path, earlier[-1]) if earlier else []
        parts = before + _put(_latest(batch.withColumn("__epoch", F.lit(epoch).cast("long")), key, order).withColumn("__bucket", bucket), path, "rows", epoch)
        heavy = [p for b in sorted({p.bucket for p in parts}) for p in outweighed([p for p in parts if p.bucket == b])]
        if heavy:
            merged = _put(_latest(_live(spark, path, heavy, schema), key, order).withColumn("__bucket", bucket), path, "whole", epoch)
            parts = [p for p in parts if p not in heavy] + merged
        spark.createDataFrame(parts, "bucket int, part string, epoch long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")
        for old in earlier[:-1]:  # the manifest before this one stays, for a repetition of this batch
            for p in set(_manifest(spark, path, old)) - set(before):
                fs, where = _path(spark, f"{path}/{p.part}/epoch={p.epoch}/__bucket={p.bucket}")
                fs.delete(where, True)
            fs, where = _path(spark, f"{path}/manifest/epoch={old}")
            fs.delete(where, True)

    return write


def read_keyed(spark: SparkSession, path: str, key: str, order: str, schema: StructType) -> DataFrame:
    """The table that upsert_sink has written to path: one row per key, as of the last complete batch."""
    done = _epochs(spark, path)
    rows = _live(spark, path, _manifest(spark, path, done[-1]) if done else [], schema)
    return _latest(rows, key, order).select(*schema.names)
