"""Joins of spans, points and frames within a file.

Every join has the file as an equality key. For long files ``width`` adds a second one: both sides
are entered under the buckets of time that they touch, and a pair is kept in one bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], key: str = "file_id", width: float | None = None) -> DataFrame:
    """Pairs of rows of one file whose spans overlap by more than a point.

    Columns other than ``key`` must differ in name between the sides.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    meet = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    right = b.withColumnRenamed(key, "_key")
    if width is None:
        return a.join(right, (F.col(key) == F.col("_key")) & meet).drop("_key")
    left = a.withColumn("_a", buckets(F.col(a0), F.col(a1), width))
    right = right.withColumn("_b", buckets(F.col(b0), F.col(b1), width))
    once = F.col("_a") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width)
    return left.join(right, (F.col(key) == F.col("_key")) & (F.col("_a") == F.col("_b")) & meet & once).drop("_key", "_a", "_b")


def point_join(points: DataFrame, spans: DataFrame, at: str, span: tuple[str, str], key: str = "file_id", slack: float = 0.0, open_ends: bool = False, width: float | None = None) -> DataFrame:
    """Pairs of a point and a span of one file that holds it, widened by ``slack`` at both ends."""
    low, high = F.col(span[0]) - slack, F.col(span[1]) + slack
    inside = (F.col(at) > low) & (F.col(at) < high) if open_ends else (F.col(at) >= low) & (F.col(at) <= high)
    right = spans.withColumnRenamed(key, "_key")
    if width is None:
        return points.join(right, (F.col(key) == F.col("_key")) & inside).drop("_key")
    left = points.withColumn("_a", F.floor(F.col(at) / width))
    right = right.withColumn("_b", buckets(low, high, width))
    return left.join(right, (F.col(key) == F.col("_key")) & (F.col("_a") == F.col("_b")) & inside).drop("_key", "_a", "_b")
