"""Shared handling of scalar parameters and saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(value: float, low: float, high: float, digits: int | None = None):
    """A node's parameter: within [low, high], floats rounded to `digits`."""
    value = max(low, min(high, value))
    return round(float(value), digits) if digits is not None else int(value)


def saturate(v: Column) -> Column:
    """To the nearest whole number in 0..255; halves go to the even one."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(v, 0))).cast("int")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter table (look-up values, weights, edges) for a broadcast join; its size doesn't depend on the data."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as the session shuffles to.

    For steps that take long per row: by their bytes alone, few rows would be put together in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
