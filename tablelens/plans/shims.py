"""Relational operators that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordered


def _free(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for f in frames for c in f.columns):
        prefix += "_"
    return prefix


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time; keys of many rows are cut by ranges of time."""
    found = ordered.asof(left, right.select(key, at, *values), [(F.col(key), F.col(key))], (F.col(at), F.col(at)))
    return found.select("_left.*", *[F.col("_right").getField(v).alias(v) for v in values])


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = f"{_free(df)}rank"
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def qualify(df: DataFrame, window: Column, condition) -> DataFrame:
    """Rows for which condition(window value) holds."""
    value = f"{_free(df)}value"
    return df.withColumn(value, window).filter(condition(F.col(value))).drop(value)


def time_bucket(c: Column, seconds: int) -> Column:
    micros = F.call_function("unix_micros", c.cast("timestamp_ltz"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")
