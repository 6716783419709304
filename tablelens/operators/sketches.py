"""Sketches of columns that merge across loads: distinct counts by HyperLogLog, quantiles by KLL.

A state is a table with a row for each column: counts, ends and two sketches of fixed size. States are stored, and states of later loads are
merged with them without reading the earlier data again. Nulls are counted and are in no sketch; an empty table has states of nothing, and merging
a state twice counts its rows twice but no value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textops import named

#: Size of the sketches: a relative error of some 1.6 % for distinct counts, of some 1 % of the ranks for quantiles.
BITS, ITEMS = 12, 200


def _number(c: Column, kind: T.DataType) -> Column | None:
    """What quantiles are of: numbers, and times as seconds."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.unix_date(c.cast("date")) * F.lit(86400.0) + (F.lit(0.0) if isinstance(kind, T.DateType) else F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("second"), c).cast("double"))
    return None


def sketch(df: DataFrame, columns: list[str] | None = None, bits: int = BITS, items: int = ITEMS) -> DataFrame:
    """(name, type, rows, filled, ranked, low, high, distinct, ranks) of each column, in one pass over df."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggregates = []
    for i, f in enumerate(fields):
        c, number = named(f.name), _number(named(f.name), f.dataType)
        text = c.cast("string")
        finite = None if number is None else F.when(~F.isnan(number), number)
        ranks = F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(finite, items)
        aggregates.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled"), (F.lit(0).cast("long") if finite is None else F.count(finite)).alias("ranked"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"), F.hll_sketch_agg(text, bits).alias("distinct"), ranks.alias("ranks")).alias(f"s{i}"))
    one = df.agg(*aggregates)
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


def merge(*states: DataFrame) -> DataFrame:
    """The state of all loads together, by their columns' names."""
    every = reduce(DataFrame.unionByName, states)
    # times as text are in order; numbers are not
    numeric, number = F.first("type").rlike("int|double|float|decimal"), lambda c: F.col(c).try_cast("double")
    low = F.when(numeric, F.min_by("low", number("low"))).otherwise(F.min("low"))
    high = F.when(numeric, F.max_by("high", number("high"))).otherwise(F.max("high"))
    return every.groupBy("name").agg(F.first("type").alias("type"), F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("ranked").alias("ranked"), low.alias("low"), high.alias("high"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double(F.when(F.col("ranked") > 0, F.col("ranks"))).alias("ranks"))


def save(state: DataFrame, path: str) -> None:
    """Adds a load's state to those stored at a path."""
    state.coalesce(1).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of all loads stored at a path."""
    return merge(spark.read.parquet(path))


def estimates(state: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(name, rows, filled, low, high, distinct_count, quantiles): what a state tells; quantiles are null for columns without an order of numbers."""
    known = F.when(F.col("ranked") > 0, F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))) for p in shares]))
    return state.select("name", "rows", "filled", "low", "high", F.hll_sketch_estimate("distinct").alias("distinct_count"), known.alias("quantiles"))
