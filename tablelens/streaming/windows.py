"""Event windows, for streams and tables alike. An addition: late events within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str | None = "10 minutes", time_col: str = "ts", key_col: str = "event_type", value_col: str = "value") -> DataFrame:
    source = events.withWatermark(time_col, watermark) if watermark and events.isStreaming else events
    out = source.groupBy(F.window(time_col, width, slide) if slide else F.window(time_col, width), key_col).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key_col, "n", "total")
