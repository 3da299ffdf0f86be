"""Event-time windows and sessions over signals, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, time: str = "ts", key: str = "file_id", value: str = "v") -> DataFrame:
    """Root mean square and greatest value by key and window; ``late`` sets a watermark."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(key, F.window(time, width, slide)).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(value).alias("peak"), F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rms", "peak", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, time: str = "ts", key: str = "file_id") -> DataFrame:
    """Sessions that end where nothing follows for ``gap``."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
