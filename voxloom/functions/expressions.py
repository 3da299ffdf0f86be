"""Column builders shared by operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, eps: float = 1e-8) -> Column:
    """Length of a vector, with ``eps`` below the root."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) + F.lit(eps))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a, eps) * norm(b, eps))


def over_threshold(a: Column, least: float = 2.6) -> Column:
    return norm(a) >= F.lit(least)


def min_max(x: Column, group: WindowSpec) -> Column:
    """Scaled to 0..1 over ``group``; 0 where all are equal."""
    low, high = F.min(x).over(group), F.max(x).over(group)
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of two spans; 0 where the hull is empty."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.coalesce(F.try_divide(F.greatest(overlap(a0, a1, b0, b1), F.lit(0.0)), F.when(hull > 0, hull)), F.lit(0.0))


def frame_time(frame: Column, rate: float) -> Column:
    return frame / F.lit(float(rate))


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def pairing_key(path: Column, strip: str | None = None) -> Column:
    """The stem without an optional ending, with only letters and digits, in lower case."""
    s = stem(path)
    if strip:
        s = F.when(F.endswith(s, F.lit(strip)), F.substring(s, F.lit(1), F.length(s) - len(strip))).otherwise(s)
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", ""))


def fit_length(values: Column, n: Column) -> Column:
    """Cropped to ``n`` items, or its last item repeated up to ``n``."""
    short = F.greatest(n - F.size(values), F.lit(0))
    return F.concat(F.slice(values, F.lit(1), F.least(n, F.size(values))), F.array_repeat(F.element_at(values, -1), short))
