"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() returned, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _dealt(df: DataFrame, key: tuple[str, ...], weight: Column) -> tuple[DataFrame, Column]:
    """df stored in ranges of the key, and for each row the weight of all ranges before its own. The driver sees a number a range."""
    dealt = stored(df.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "ranges")
    before, at = [(-1, 0)], 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum(weight)).collect()):
        before.append((part, at))
        at += n
    table = F.create_map(*(F.lit(x) for kv in before for x in kv))
    return dealt, F.element_at(table, F.col("__part")).cast("long")


def numbered(df: DataFrame, *key: str, name: str = "idx") -> DataFrame:
    """df with the place of each row in the order of key, from 0, nulls first, without gathering rows in one task."""
    dealt, before = _dealt(df, key, F.lit(1))
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*key)) - 1 + before).drop("__part")


def running_total(df: DataFrame, *key: str, weight: str, name: str = "before") -> DataFrame:
    """df with the sum of weight (a whole number) over all rows before each in the order of key, whose values are distinct."""
    dealt, before = _dealt(df, key, F.col(weight))
    own = Window.partitionBy("__part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, (F.sum(weight).over(own) - F.col(weight) + before).cast("long")).drop("__part")
