"""Frames inside segments pooled to one vector each.

``frames`` has file_id, frame and vec; ``segments`` has file_id, segment_id, start, peak, end in
seconds. Bounds are frame numbers, cut off (``bounds="trunc"``) or rounded half to even
(``bounds="round"``) and clamped to the file's frames; an empty span takes its nearest frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reducer = Callable[[Column], Column]
_POOLERS: dict[str, Reducer] = {"mean": F.avg, "max": F.max, "median": F.median}


def register_pooler(name: str, reduce: Reducer) -> None:
    _POOLERS[name.lower()] = reduce


def list_poolers() -> list[str]:
    return sorted([*_POOLERS, "onc"])


def get_pooler(name: str) -> Callable[..., DataFrame]:
    name = name.lower()
    if name == "onc":
        return pool_onset_nucleus_coda
    if name not in _POOLERS:
        raise ValueError(f"unknown pooler: {name}; there are {', '.join(list_poolers())}")
    return lambda frames, segments, fps, **options: pool(frames, segments, fps, name, **options)


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy(F.col("file_id").alias("_f")).agg((F.max("frame") + 1).alias("_n"))


def frame_bounds(segments: DataFrame, frames: DataFrame, fps: float, bounds: str = "trunc") -> DataFrame:
    """Segments with ``first`` and ``last``, the half-open range of frames that each pools."""
    whole = {"trunc": lambda c: c.cast("int"), "round": lambda c: F.bround(c).cast("int")}[bounds]
    counted = segments.join(frame_counts(frames), F.col("file_id") == F.col("_f")).drop("_f")
    top = F.col("_n") - 1
    a, b = F.greatest(whole(F.col("start") * fps), F.lit(0)), F.least(whole(F.col("end") * fps), F.col("_n"))
    a = F.least(a, top)
    return counted.select("file_id", "segment_id", a.alias("first"), F.greatest(b, a + 1).alias("last"))


def pool(frames: DataFrame, segments: DataFrame, fps: float, method: str = "mean", *, bounds: str = "trunc") -> DataFrame:
    """(file_id, segment_id, embedding); files without frames give no row."""
    spans = frame_bounds(segments, frames, fps, bounds).withColumnRenamed("file_id", "_f")
    inside = (F.col("file_id") == F.col("_f")) & (F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last"))
    cells = frames.select("file_id", "frame", "vec").join(spans, inside).select("file_id", "segment_id", F.posexplode("vec").alias("dim", "x"))
    each = cells.groupBy("file_id", "segment_id", "dim").agg(_POOLERS[method](F.col("x").cast("double")).alias("x"))
    packed = each.groupBy("file_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    return packed.select("file_id", "segment_id", F.transform("cells", lambda c: c["x"]).alias("embedding"))


def pool_onset_nucleus_coda(frames: DataFrame, segments: DataFrame, fps: float, **_: object) -> DataFrame:
    """The frames at 30 % of the onset, at the peak and at 70 % of the coda, one after another."""
    counted = segments.join(frame_counts(frames), F.col("file_id") == F.col("_f")).drop("_f")
    onset = F.col("start") + 0.3 * (F.col("peak") - F.col("start"))
    coda = F.col("peak") + 0.7 * (F.col("end") - F.col("peak"))
    at = lambda t: F.least(F.greatest(F.bround(t * fps).cast("int"), F.lit(0)), F.col("_n") - 1)
    spots = F.array(*(F.struct(F.lit(k).alias("part"), at(t).alias("frame")) for k, t in enumerate((onset, F.col("peak"), coda))))
    asked = counted.select("file_id", "segment_id", F.explode(spots).alias("s")).select("file_id", "segment_id", "s.part", "s.frame")
    got = asked.join(frames.select("file_id", "frame", "vec"), ["file_id", "frame"])
    parts = got.groupBy("file_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("part", "vec"))).alias("parts"))
    return parts.select("file_id", "segment_id", F.flatten(F.transform("parts", lambda p: p["vec"].cast("array<double>"))).alias("embedding"))


def pool_segments(frames: DataFrame, segments: DataFrame, method: str = "mean", *, sr: int | None = None, hop_length: int | None = None, fps: float | None = None) -> DataFrame:
    """Pool by method name; the frame rate is given, or the ratio of sample rate and hop, or else estimated by file.

    The estimate takes a file's last segment to end with its last frame; where none ends after 0 it is 50.
    """
    if fps is None and sr and hop_length:
        fps = sr / hop_length
    if fps is not None:
        return get_pooler(method)(frames, segments, fps)
    ends = segments.groupBy(F.col("file_id").alias("_g")).agg(F.max("end").alias("_end")).join(frame_counts(frames), F.col("_g") == F.col("_f"))
    rates = ends.select("_g", F.when(F.col("_end") > 0, F.col("_n") / F.col("_end")).otherwise(50.0).alias("_rate"))
    spans = segments.join(rates, F.col("file_id") == F.col("_g")).drop("_g")
    in_frames = spans.withColumns({c: F.col(c) * F.col("_rate") for c in ("start", "peak", "end") if c in spans.columns}).drop("_rate")
    return get_pooler(method)(frames, in_frames, 1.0)


def valid_segments(segments: DataFrame, pooling: str = "mean") -> DataFrame:
    """Segments whose times are finite, not negative and in order; a missing peak becomes the middle.

    Poolers that need a real peak (onc, max) refuse a missing one. Bad rows raise when they are read.
    """
    peak = F.col("peak") if "peak" in segments.columns else F.lit(None).cast("double")
    if pooling in ("onc", "max"):
        peak = F.coalesce(peak, F.raise_error(F.lit(f"{pooling} pooling needs a peak")).cast("double"))
    peak = F.coalesce(peak, (F.col("start") + F.col("end")) / 2)
    finite = ~F.isnan("start") & ~F.isnan(peak) & ~F.isnan("end") & (F.col("end") < float("inf"))
    good = finite & (F.col("start") >= 0) & (F.col("start") <= peak) & (peak <= F.col("end"))
    check = lambda c: F.when(good, c).otherwise(F.raise_error(F.lit("segment times must be finite and in order")).cast("double"))
    return segments.withColumns({"start": check(F.col("start")), "peak": check(peak)})
