"""Operators on frames and signals that are plain expressions, joins and windows.

Frames are (file_id, frame, vec), signals (file_id, idx, t, v), attention (file_id, head, frame, w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.expressions import cosine, dot, min_max, norm


def norms(frames: DataFrame) -> DataFrame:
    return frames.select("file_id", "frame", norm(F.col("vec")).alias("norm"))


def active_frames(frames: DataFrame, least: float = 2.6) -> DataFrame:
    return frames.select("file_id", "frame", (norm(F.col("vec")) >= least).alias("active"))


def adjacent_cosine(frames: DataFrame) -> DataFrame:
    """Similarity of each frame with the one before it in its file; null for the first."""
    before = F.lag("vec").over(W.partitionBy("file_id").orderBy("frame"))
    return frames.withColumn("_b", before).select("file_id", "frame", F.when(F.col("_b").isNotNull(), cosine(F.col("vec"), F.col("_b"))).alias("similarity"))


def stable_peaks(frames: DataFrame, segments: DataFrame, fps: float) -> DataFrame:
    """Segments (file_id, segment_id, start, end) with ``peak``, the frame most like its neighbours inside the segment.

    Bounds are rounded half to even; the first frame wins ties, and is the peak of a segment of one.
    """
    count = frames.groupBy(F.col("file_id").alias("_f")).agg((F.max("frame") + 1).alias("_n"))
    at = lambda c: F.bround(F.col(c) * fps).cast("int")
    spans = segments.join(count, F.col("file_id") == F.col("_f"))
    first = F.least(F.greatest(at("start"), F.lit(0)), F.col("_n") - 1)
    spans = spans.select("_f", "segment_id", "start", "end", first.alias("first"), F.greatest(F.least(at("end"), F.col("_n")), first + 1).alias("last"))
    inside = (F.col("file_id") == F.col("_f")) & (F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last"))
    w = W.partitionBy("file_id", "segment_id").orderBy("frame")
    rows = frames.select("file_id", "frame", "vec").join(spans, inside).withColumn("_b", F.lag("vec").over(w))
    size = F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(F.col("_b"), F.col("_b")))
    like = F.when(F.col("_b").isNotNull(), F.coalesce(F.try_divide(dot(F.col("vec"), F.col("_b")), size), F.lit(0.0)))
    rows = rows.withColumn("_like", like).withColumn("_next", F.lead("_like").over(w))
    both = F.coalesce((F.col("_like") + F.col("_next")) / 2, F.col("_like"), F.col("_next"), F.lit(0.0))
    best = F.max(F.struct(both.alias("s"), (-F.col("frame")).alias("k")))["k"]
    return rows.groupBy("file_id", "segment_id", "start", "end").agg((-best / fps).alias("peak"))


def self_similarity_envelope(frames: DataFrame, normalize: bool = True) -> DataFrame:
    """Mean cosine of each frame with all frames of its file, over the file's least similarity.

    The similarity matrix is shifted so that its least entry is 1e-7. Frames of a file are paired by
    a self-join on the file; long files belong to the kernel of the same name.
    """
    unit = F.sqrt(dot(F.col("vec"), F.col("vec")))
    a = frames.select("file_id", "frame", "vec", unit.alias("l"))
    b = a.select(F.col("file_id").alias("_f"), F.col("vec").alias("_vec"), F.col("l").alias("_l"))
    sim = dot(F.col("vec"), F.col("_vec")) / F.greatest(F.col("l") * F.col("_l"), F.lit(1e-8))
    rows = a.join(b, F.col("file_id") == F.col("_f")).groupBy("file_id", "frame").agg(F.avg(sim).alias("m"), F.min(sim).alias("low"))
    every = W.partitionBy("file_id")
    shifted = rows.select("file_id", "frame", (F.col("m") - F.min("low").over(every) + F.lit(1e-7)).alias("v"))
    return shifted.select("file_id", "frame", min_max(F.col("v"), every).alias("v")) if normalize else shifted


def normalized(signal: DataFrame, value: str = "v") -> DataFrame:
    return signal.withColumn(value, min_max(F.col(value), W.partitionBy("file_id")))


def smoothed(signal: DataFrame, kernel: list[float], value: str = "v", order: str = "idx") -> DataFrame:
    """Convolution with an odd kernel, zeros beyond both ends."""
    w, half = W.partitionBy("file_id").orderBy(order), len(kernel) // 2
    terms = [F.coalesce((F.lead if k >= half else F.lag)(value, abs(k - half)).over(w), F.lit(0.0)) * c for k, c in enumerate(reversed(kernel))]
    total: Column = F.lit(0.0)
    for t in terms:
        total = total + t
    return signal.withColumn(value, total)


def moving_rms(signal: DataFrame, frame_length: int, hop: int, value: str = "v") -> DataFrame:
    """Root mean square of centred frames, one every ``hop`` samples; samples beyond the ends count as zero."""
    half = frame_length // 2
    w = W.partitionBy("file_id").orderBy("idx").rowsBetween(-half, frame_length - half - 1)
    rows = signal.withColumn("_s", F.sum(F.col(value) * F.col(value)).over(w))
    return rows.filter(F.col("idx") % hop == 0).select("file_id", F.expr(f"idx div {hop}").alias("frame"), F.sqrt(F.col("_s") / frame_length).alias("v"))


def moving_average(signal: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Mean of ``n`` samples around each (fewer at the ends)."""
    half = n // 2
    w = W.partitionBy("file_id").orderBy("idx").rowsBetween(-half, n - half - 1)
    return signal.withColumn(value, F.avg(value).over(w))


# ---- attention -----------------------------------------------------------------------------------


def importance_masks(attention: DataFrame, quantile: float = 0.5) -> DataFrame:
    """``important`` where a head's weight reaches its own linear quantile in the file."""
    edge = attention.groupBy("file_id", "head").agg(F.percentile("w", F.lit(quantile)).alias("edge"))
    return attention.join(edge, ["file_id", "head"]).select("file_id", "head", "frame", "w", (F.col("w") >= F.col("edge")).alias("important"))


def importance_union(attention: DataFrame, quantile: float = 0.5) -> DataFrame:
    return importance_masks(attention, quantile).groupBy("file_id", "frame").agg(F.bool_or("important").alias("important"))


def combine_heads(attention: DataFrame, how: str | int = "max") -> DataFrame:
    """One weight a frame: the heads' maximum or mean, or one head's."""
    if isinstance(how, int):
        return attention.filter(F.col("head") == how).select("file_id", "frame", "w")
    agg = {"max": F.max, "mean": F.avg}
    if how not in agg:
        raise ValueError(f"unknown way to combine heads: {how}")
    return attention.groupBy("file_id", "frame").agg(agg[how]("w").alias("w"))


def attention_envelope(attention: DataFrame, quantile: float = 0.5, method: str = "max", normalize: bool = True) -> DataFrame:
    """Importance over time: max of the important weights, their sum over the union, or their mean; 0 elsewhere."""
    important = F.when(F.col("important"), F.col("w"))
    reduce = {"max": F.max(important), "union_strength": F.sum(important), "mean_important": F.avg(important)}
    if method not in reduce:
        raise ValueError(f"unknown method: {method}")
    rows = importance_masks(attention, quantile).groupBy("file_id", "frame").agg(F.coalesce(reduce[method], F.lit(0.0)).alias("v"))
    return normalized(rows) if normalize else rows


def runs(flags: DataFrame, flag: str = "important", gap: int = 0) -> DataFrame:
    """Runs of frames with ``flag``: (file_id, first, last), the end not included; gaps of up to ``gap`` frames are bridged."""
    w = W.partitionBy("file_id").orderBy("frame")
    on = flags.filter(F.col(flag)).select("file_id", "frame")
    new = F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1 > gap, F.lit(True))
    on = on.withColumn("_new", new).withColumn("run", F.sum(F.col("_new").cast("int")).over(w))
    return on.groupBy("file_id", "run").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("last")).drop("run")


def attention_segments(attention: DataFrame, rate: float, quantile: float = 0.9, merge_valley_tol: float = 0.0) -> DataFrame:
    """Segments where any head is important: start, peak (greatest sum of heads, the first on ties) and end in seconds.

    A segment ends at its last frame. Single-frame runs are dropped unless all are; a file without runs is one segment from end to end.
    """
    union = importance_union(attention, quantile)
    found = runs(union, gap=int(merge_valley_tol * rate + 1e-9))
    every = W.partitionBy("file_id")
    found = found.withColumn("_long", F.max((F.col("last") - F.col("first") > 1).cast("int")).over(every)).filter("_long = 0 OR last - first > 1")
    count = attention.groupBy(F.col("file_id").alias("_f")).agg((F.max("frame") + 1).alias("_n"))
    found = count.join(found, F.col("_f") == F.col("file_id"), "left").select(F.col("_f").alias("file_id"), F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", "_n").alias("last"), "_n")
    sums = attention.groupBy(F.col("file_id").alias("_f"), "frame").agg(F.sum("w").alias("_s"))
    inside = (F.col("file_id") == F.col("_f")) & (F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last"))
    peak = F.max(F.struct("_s", (-F.col("frame")).alias("k")))["k"]
    rows = found.join(sums, inside).groupBy("file_id", "first", "last", "_n").agg((-peak).alias("peak"))
    return rows.select("file_id", (F.col("first") / rate).alias("start"), (F.col("peak") / rate).alias("peak"), ((F.col("last") - 1) / rate).alias("end"))


# ---- peaks and valleys ---------------------------------------------------------------------------


def drop_shallow_valleys(valleys: DataFrame, peaks: DataFrame, tol: float) -> DataFrame:
    """Valleys (file_id, t, v) no higher than ``tol`` times the higher of the peaks beside them; a missing peak is 0."""
    both = valleys.select("file_id", "t", "v", F.lit(False).alias("is_peak")).unionByName(peaks.select("file_id", "t", "v", F.lit(True).alias("is_peak")))
    value = F.when(F.col("is_peak"), F.col("v"))
    back = W.partitionBy("file_id").orderBy("t", "is_peak").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("file_id").orderBy("t", F.desc("is_peak")).rowsBetween(1, W.unboundedFollowing)
    rows = both.select("*", F.coalesce(F.last(value, True).over(back), F.lit(0.0)).alias("_l"), F.coalesce(F.first(value, True).over(ahead), F.lit(0.0)).alias("_r"))
    return rows.filter(~F.col("is_peak") & (F.col("v") <= tol * F.greatest("_l", "_r"))).select("file_id", "t", "v")


def merge_valleys(valleys: DataFrame, tol: float) -> DataFrame:
    """Of valleys that follow one another within ``tol`` seconds the deepest, the first on ties."""
    w = W.partitionBy("file_id").orderBy("t")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > tol, F.lit(True)).cast("int")
    rows = valleys.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    best = F.min(F.struct("v", "t"))
    return rows.groupBy("file_id", "_g").agg(best.alias("b")).select("file_id", F.col("b.t").alias("t"), F.col("b.v").alias("v"))


def edge_valleys(valleys: DataFrame, signal: DataFrame, onset: float) -> DataFrame:
    """Valley times with 0 and the signal's end where the outer valleys are further than ``onset`` from them."""
    ends = signal.groupBy("file_id").agg(F.max("t").alias("_end"))
    outer = valleys.groupBy("file_id").agg(F.min("t").alias("_a"), F.max("t").alias("_b")).join(ends, "file_id")
    added = F.array(F.when(F.col("_a") > onset, F.lit(0.0)), F.when(F.col("_b") < F.col("_end") - onset, F.col("_end")))
    extra = outer.select("file_id", F.explode(F.filter(added, lambda x: x.isNotNull())).alias("t"))
    return valleys.select("file_id", "t").unionByName(extra)


def peaks_between_valleys(valleys: DataFrame, peaks: DataFrame, *, min_dur: float = 0.0, max_dur: float | None = None, cutoff: float | None = None) -> DataFrame:
    """Segments from valley to valley with the highest peak strictly inside, the first on ties."""
    w = W.partitionBy("file_id").orderBy("t")
    spans = valleys.select(F.col("file_id").alias("_f"), F.col("t").alias("start"), F.lead("t").over(w).alias("end")).filter("end IS NOT NULL")
    inside = (F.col("file_id") == F.col("_f")) & (F.col("t") > F.col("start")) & (F.col("t") < F.col("end"))
    best = F.max(F.struct("v", (-F.col("t")).alias("k"))).alias("b")
    rows = peaks.select("file_id", "t", "v").join(spans, inside).groupBy("file_id", "start", "end").agg(best)
    rows = rows.select("file_id", "start", (-F.col("b.k")).alias("peak"), "end", F.col("b.v").alias("amplitude"))
    dur = F.col("end") - F.col("start")
    keep = dur >= min_dur
    if max_dur is not None:
        keep = keep & (dur <= max_dur)
    if cutoff is not None:
        keep = keep & (F.col("amplitude") >= cutoff)
    return rows.filter(keep)


def split_at_gaps(signal: DataFrame, gap: float) -> DataFrame:
    """Sessions of a signal: segments that end where nothing follows for ``gap`` seconds, with their highest sample as peak."""
    w = W.partitionBy("file_id").orderBy("idx")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True)).cast("int")
    rows = signal.withColumn("_new", new).withColumn("segment_id", F.sum("_new").over(w) - 1)
    peak = F.max(F.struct("v", (-F.col("idx")).alias("k"), "t"))["t"]
    return rows.groupBy("file_id", "segment_id").agg(F.min("t").alias("start"), peak.alias("peak"), F.max("t").alias("end"), F.count("*").alias("n"))


def segments_to_envelope(segments: DataFrame, frames: DataFrame, method: str = "segment_mask") -> DataFrame:
    """Segments (file_id, first, last) as a signal over ``frames``: 1 inside, or 1 at each boundary."""
    at = frames.select("file_id", "frame").distinct()
    seg = segments.select(F.col("file_id").alias("_f"), "first", "last")
    if method == "segment_mask":
        on = (F.col("file_id") == F.col("_f")) & (F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last"))
    elif method == "boundary_impulse":
        on = (F.col("file_id") == F.col("_f")) & ((F.col("frame") == F.col("first")) | (F.col("frame") == F.col("last")))
    else:
        raise ValueError(f"unknown method: {method}")
    return at.join(seg, on, "left").groupBy("file_id", "frame").agg(F.max(F.when(F.col("_f").isNotNull(), 1.0).otherwise(0.0)).alias("v"))
