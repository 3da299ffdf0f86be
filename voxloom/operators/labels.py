"""Labels of annotation tiers attached to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.expressions import overlap
from voxloom.operators.intervals import overlap_join

MODES = ("sequence", "nucleus", "max_overlap", "first")


def attach_labels(
    segments: DataFrame,
    tiers: DataFrame,
    *,
    mode: str = "sequence",
    ratio: float = 0.5,
    seconds: float = 0.03,
    keys: tuple[str, ...] = ("file_id", "segment_id"),
    width: float | None = None,
) -> DataFrame:
    """Segments with eight label columns.

    ``tiers`` has file_id, interval_idx, xmin, xmax, text and optionally path. An interval is attached
    if it overlaps the segment by ``seconds``, or by ``ratio`` of its own length. The label of
    greatest overlap and that at the segment's peak are the first in interval order on ties. Blank
    labels take no part; segments of files without annotation keep empty labels.
    """
    mode = mode.replace("-", "_")
    if mode not in MODES:
        raise ValueError(f"unknown label mode: {mode}")
    marks = tiers.filter(F.trim("text") != "").select("file_id", F.col("interval_idx").alias("_k"), "xmin", "xmax", F.trim("text").alias("_label"))
    slim = segments.select(*keys, "start", "peak", "end")
    met = overlap_join(slim, marks, ("start", "end"), ("xmin", "xmax"), width=width)
    met = met.withColumn("_ov", overlap(F.col("start"), F.col("end"), F.col("xmin"), F.col("xmax")))
    attached = (F.col("_ov") >= seconds) | (F.col("_ov") / F.greatest(F.lit(1e-6), F.col("xmax") - F.col("xmin")) >= ratio)
    at_peak = (F.col("peak") >= F.col("xmin")) & (F.col("peak") <= F.col("xmax"))
    in_order = F.array_sort(F.collect_list(F.when(attached, F.struct("_k", "_label"))))
    found = met.groupBy(*keys).agg(
        F.transform(in_order, lambda x: x["_label"]).alias("tg_labels"),
        F.max(F.struct("_ov", (-F.col("_k")).alias("_k"), "_label"))["_label"].alias("primary_label_max_overlap"),
        F.min(F.when(at_peak, F.struct("_k", "_label")))["_label"].alias("primary_label_peak"),
    )
    paths = tiers.groupBy("file_id").agg((F.max("path") if "path" in tiers.columns else F.lit(None).cast("string")).alias("textgrid_path"), F.lit(True).alias("_has"))
    held = {k: f"_k_{k}" for k in keys}
    found = found.select(*(F.col(k).alias(v) for k, v in held.items()), "tg_labels", "primary_label_max_overlap", "primary_label_peak")
    same = None
    for k, v in held.items():
        same = F.col(k).eqNullSafe(F.col(v)) if same is None else same & F.col(k).eqNullSafe(F.col(v))
    out = segments.join(found, same, "left").drop(*held.values()).join(paths.withColumnRenamed("file_id", "_f"), F.col("file_id") == F.col("_f"), "left").drop("_f")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    labels = F.coalesce("tg_labels", F.array().cast("array<string>"))
    primary = {
        "sequence": F.array_join(labels, " "),
        "nucleus": blank("primary_label_peak"),
        "max_overlap": blank("primary_label_max_overlap"),
        "first": F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("")),
    }[mode]
    known = F.coalesce("_has", F.lit(False))
    return out.select(
        *segments.columns,
        labels.alias("tg_labels"),
        F.array_join(labels, " ").alias("tier_labels_concat"),
        primary.alias("primary_label"),
        blank("primary_label_peak").alias("primary_label_peak"),
        blank("primary_label_max_overlap").alias("primary_label_max_overlap"),
        F.coalesce("textgrid_path", F.lit("")).alias("textgrid_path"),
        (F.size(labels) > 0).alias("label_attached"),
        F.when(known, "textgrid").otherwise("none").alias("label_source"),
    )
