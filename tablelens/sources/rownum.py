"""Dense row numbers in file order without sorting the rows.

A first pass counts the rows of each split; their sums in file order are the splits' offsets, a table of one row per
split; a second pass adds the offset to the row's place in its split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.profile import ROW


def in_file_order(df: DataFrame, file_rank: Column, block: Column, name: str = ROW, place: str | None = None) -> DataFrame:
    """df with its row numbers from 1. file_rank and block order the splits; the scan's own order counts within one. place: numbers within the file as well."""
    marked = df.withColumns({"_f": file_rank, "_b": block, "_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    splits = marked.groupBy("_f", "_b", "_p").agg(F.min("_m").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # as many rows as the scan has splits
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b", "_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("_f", "_b", "_p", (before - F.col("_low") + 1).alias("_o"), before.alias("_t")).withColumn("_t", F.min("_t").over(W.partitionBy("_f")))
    out = marked.join(F.broadcast(offsets), ["_f", "_b", "_p"])
    within = [(F.col("_m") + F.col("_o") - F.col("_t")).cast("long").alias(place)] if place else []
    return out.select((F.col("_m") + F.col("_o")).cast("long").alias(name), *within, *[F.col(f"`{c}`") for c in df.columns])
