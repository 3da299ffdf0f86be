"""Files collected by suffix and paired by stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.expressions import pairing_key, stem, suffix


def with_suffix(files: DataFrame, suffixes: list[str], path_col: str = "path") -> DataFrame:
    """Rows whose path has one of ``suffixes`` in any case."""
    return files.filter(suffix(F.col(path_col)).isin([s.lower() for s in suffixes]))


def pair_by_stem(left: DataFrame, right: DataFrame, left_col: str = "path", right_col: str = "path", strip: str | None = None) -> DataFrame:
    """(key, left_path, right_path) for stems found on both sides.

    Of several paths with one key, the last in path order holds. ``strip`` is an ending taken off
    the right side's stems. Both sides are reduced by partial aggregation before they meet.
    """
    a = left.groupBy(pairing_key(F.col(left_col)).alias("key")).agg(F.max(left_col).alias("left_path"))
    b = right.groupBy(pairing_key(F.col(right_col), strip).alias("key")).agg(F.max(right_col).alias("right_path"))
    return a.join(b, "key")


def annotation_lookup(audio: DataFrame, annotations: DataFrame, strip: str | None = None) -> DataFrame:
    """(file_stem, textgrid_path): the annotation of each audio stem."""
    pairs = pair_by_stem(audio, annotations, strip=strip)
    return pairs.select(stem(F.col("left_path")).alias("file_stem"), F.col("right_path").alias("textgrid_path"))
