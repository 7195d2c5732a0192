"""Column expressions over way tags and points."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from roadspark.functions import constants as C


def lookup(table: dict, key: Column) -> Column:
    """The value of key in a small fixed table, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def leading_number(text: Column) -> Column:
    """The positive number that text starts with, else null."""
    value = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when(value > 0, value)


def speed_kmh() -> Column:
    return F.coalesce(leading_number(tag("avg_max_speed")), leading_number(tag("maxspeed")), lookup(C.SPEED_KMH, tag("highway")), F.lit(C.DEFAULT_SPEED_KMH))


def forward() -> Column:
    return F.coalesce(tag("oneway"), F.lit("")) != "-1"


def backward() -> Column:
    one = F.coalesce(tag("oneway"), F.lit(""))
    return ~((one == "yes") | (~one.isin("yes", "-1", "no") & (F.coalesce(tag("junction"), F.lit("")) == "roundabout")))


def distance(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    return F.sqrt((x - to_x) * (x - to_x) + (y - to_y) * (y - to_y))


def _of_c(f: Callable[..., float]) -> Callable[..., Column]:
    """f of the C library as a column function. Java's last bit differs now and then, which decides where a value meets a threshold exactly."""

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) if all(map(math.isfinite, row)) else math.nan for row in zip(*columns, strict=True)], dtype="float64")

    return run


cos, sin = _of_c(math.cos), _of_c(math.sin)
atan2 = _of_c(lambda y, x: math.atan2(y + 0.0, x + 0.0))  # as in Spark, -0.0 is 0.0
