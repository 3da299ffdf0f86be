"""Entry points: whole corpora in, DataFrames out."""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.expressions import pairing_key, stem
from voxloom.operators import discovery, evaluation, pooling, segmentation
from voxloom.operators.manifests import join_corpus
from voxloom.presets import resolve_preset, segmenter_preset
from voxloom.sources import annotations, audio, stores


def segment_audio(waves: DataFrame, method: str = "peakdetect", *, envelope: str = "sbs", features: str | None = None, rate: float = 50.0, envelope_kwargs: dict[str, Any] | None = None, feature_kwargs: dict[str, Any] | None = None, fail: bool = True, preset: str | None = None, **options: Any) -> DataFrame:
    """Segments of waveforms: by peaks of an envelope, by a frame segmenter on extracted features, or by attention.

    A segmenter preset names method, envelope or features, and their options; options given beside it go first.
    """
    if preset is not None:
        fixed = segmenter_preset(preset)
        method, envelope, features = fixed["method"], fixed.get("envelope", envelope), fixed.get("features", features)
        envelope_kwargs = {**fixed.get("envelope_kwargs", {}), **(envelope_kwargs or {})}
        options = {**fixed["kwargs"], **options}
    if segmentation.segmenter_name(method) == "peakdetect":
        signal = segmentation.envelope_of(waves, envelope, fail=fail, **(envelope_kwargs or {}))
        return segmentation.segment_signal(signal, fail=fail, **options)
    if segmentation.segmenter_name(method) == "cls_attention":
        weights = segmentation.attention_of(waves, features or "vghubert", fail=fail, **(feature_kwargs or {}))
        return segmentation.segment_frames(weights, method, rate, fail=fail, **options)
    frames = segmentation.features_of(waves, features or "mfcc", fail=fail, **(feature_kwargs or {}))
    return segmentation.segment_frames(frames, method, rate, fail=fail, **options)


def embed_corpus(waves: DataFrame, *, preset: str | None = None, segmentation_method: str | None = None, features: str | None = None, pooling_method: str | None = None, rate: float = 50.0, segmentation_kwargs: dict[str, Any] | None = None, feature_kwargs: dict[str, Any] | None = None, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, embeddings) of all files from one extraction of frames; files that fail have none."""
    _, segments, pooled = _embedded(waves, preset, segmentation_method, features, pooling_method, rate, segmentation_kwargs, feature_kwargs, fail)
    return segments, pooled


def _embedded(waves: DataFrame, preset: str | None, segmentation_method: str | None, features: str | None, pooling_method: str | None, rate: float, segmentation_kwargs: dict[str, Any] | None, feature_kwargs: dict[str, Any] | None, fail: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    recipe = resolve_preset(preset, segmentation=segmentation_method, features=features, pooling=pooling_method, segmentation_kwargs=segmentation_kwargs, feature_kwargs=feature_kwargs)
    results = segmentation.extract(waves, recipe["features"], fail=fail, **recipe["feature_kwargs"]).persist(StorageLevel.MEMORY_AND_DISK)
    frames = segmentation.frames_of(results)
    options = dict(recipe["segmentation_kwargs"])
    if recipe["segmentation"] == "peakdetect":
        segments = segment_audio(waves, envelope=options.pop("envelope"), fail=fail, **options)
    elif segmentation.segmenter_name(recipe["segmentation"]) == "cls_attention":
        segments = segment_audio(waves, "cls_attention", features=recipe["features"], rate=rate, feature_kwargs=recipe["feature_kwargs"], fail=fail, **options)
    else:
        segments = segmentation.segment_frames(frames, recipe["segmentation"], rate, fail=fail, **options)
    segments = segments.persist(StorageLevel.MEMORY_AND_DISK)
    pooled = pooling.pool_segments(frames, pooling.valid_segments(segments, recipe["pooling"]), recipe["pooling"], fps=rate)
    return results.select("file_id", "success", "error"), segments, pooled


def embed_corpus_to_storage(waves: DataFrame, path: str, *, preset: str | None = None, segmentation_method: str | None = None, features: str | None = None, pooling_method: str | None = None, rate: float = 50.0, segmentation_kwargs: dict[str, Any] | None = None, feature_kwargs: dict[str, Any] | None = None, buckets: int = 64) -> DataFrame:
    """Segments, embeddings (partitioned by a hash of the file) and a manifest of all files below ``path``; returns the manifest."""
    status, segments, pooled = _embedded(waves, preset, segmentation_method, features, pooling_method, rate, segmentation_kwargs, feature_kwargs, False)
    recipe = resolve_preset(preset, segmentation=segmentation_method, features=features, pooling=pooling_method, segmentation_kwargs=segmentation_kwargs, feature_kwargs=feature_kwargs)
    spark, at = waves.sparkSession, f"{path}/embeddings"
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    pooled.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
    sizes = spark.read.parquet(at).groupBy("file_id").agg(F.count("*").cast("int").alias("num_rows"), F.max(F.size("embedding")).alias("embedding_dim"))
    told = {"segmentation": recipe["segmentation"], "features": recipe["features"], "pooling": recipe["pooling"], "preset": preset}
    manifest = waves.select("file_id", F.col("path").alias("audio_path")).join(status, "file_id", "left").join(sizes, "file_id", "left")
    manifest = manifest.select(
        "file_id", "audio_path", F.lit(at).alias("embedding_path"), F.coalesce("num_rows", F.lit(0)).alias("num_rows"), F.coalesce("embedding_dim", F.lit(0)).alias("embedding_dim"),
        F.coalesce("success", F.lit(False)).alias("success"), "error", *(F.lit(v).cast("string").alias(k) for k, v in told.items()),
    )
    stores.write_embedding_manifest(manifest, f"{path}/manifest", mode="overwrite")
    return stores.load_embedding_manifest(spark, f"{path}/manifest")


class EmbeddingPipeline:
    """One recipe of segmentation, features and pooling, kept for several corpora."""

    def __init__(self, **recipe: Any):
        self.recipe = recipe
        names = {"segmentation": "segmentation_method", "pooling": "pooling_method"}
        self.options = {names.get(k, k): v for k, v in recipe.items()}

    def embed_corpus(self, waves: DataFrame, *, fail: bool = False) -> tuple[DataFrame, DataFrame]:
        return embed_corpus(waves, fail=fail, **self.options)

    embed_audio = embed_corpus

    def embed_corpus_to_storage(self, waves: DataFrame, path: str, *, buckets: int = 64) -> DataFrame:
        return embed_corpus_to_storage(waves, path, buckets=buckets, **self.options)


def segment_and_embed(waves: DataFrame, *, segmentation_method: str = "peakdetect", features: str = "mfcc", pooling_method: str = "mean", **embed: Any) -> tuple[DataFrame, DataFrame]:
    """(segments, embeddings); peaks need an envelope among the options of the segmentation."""
    return embed_corpus(waves, segmentation_method=segmentation_method, features=features, pooling_method=pooling_method, **embed)


def segment_embed_and_discover(waves: DataFrame, *, discovery_method: str = "kmeans", discovery_kwargs: dict[str, Any] | None = None, **embed: Any) -> tuple[DataFrame, DataFrame, discovery.DiscoveryResult]:
    """(segments, embeddings, clusters of the embeddings) of waveforms."""
    segments, embeddings = segment_and_embed(waves, **embed)
    return segments, embeddings, discovery.DiscoveryPipeline(discovery_method, **(discovery_kwargs or {})).discover(embeddings)


def discover_corpus(waves: DataFrame, *, discovery_method: str = "kmeans", discovery_kwargs: dict[str, Any] | None = None, output_dir: str | None = None, **embed: Any) -> tuple[DataFrame, discovery.DiscoveryPipeline]:
    """Segments of all files with their cluster, and the fitted pipeline; both are also written below ``output_dir``."""
    if output_dir is None:
        segments, embeddings = embed_corpus(waves, **embed)
    else:
        spark = waves.sparkSession
        embed_corpus_to_storage(waves, output_dir, **embed)
        segments, embeddings = spark.read.parquet(f"{output_dir}/segments"), spark.read.parquet(f"{output_dir}/embeddings").drop("bucket")
    pipeline = discovery.DiscoveryPipeline(discovery_method, **(discovery_kwargs or {})).fit(embeddings)
    labels = pipeline.predict(embeddings).select("file_id", "segment_id", "cluster_label")
    files = waves.select("file_id", F.col("path").alias("audio_path"))
    out = join_corpus(segments, files, discovery=labels)
    if output_dir is not None:
        out.write.mode("overwrite").parquet(f"{output_dir}/discovered")
        pipeline.save(f"{output_dir}/model", overwrite=True)
        out = waves.sparkSession.read.parquet(f"{output_dir}/discovered")
    return out, pipeline


def pair_waves(waves: DataFrame, tiers: DataFrame, strip: str | None = None) -> DataFrame:
    """``tiers`` with the file_id of the waveform whose stem theirs pairs with; the last path of a stem holds."""
    left = waves.groupBy(pairing_key(F.col("path")).alias("_key")).agg(F.max(F.struct("path", "file_id"))["file_id"].alias("file_id"))
    keyed = tiers.withColumn("_key", pairing_key(F.col("path"), strip))
    last = keyed.groupBy("_key").agg(F.max("path").alias("_last"))
    keyed = keyed.join(last, "_key").filter(F.col("path") == F.col("_last")).drop("_last")
    return keyed.join(left, "_key").drop("_key")


def evaluate_segmentation(segments: DataFrame, tiers: DataFrame, names: dict[str, int], tolerance: float = evaluation.TOLERANCE, vowels: tuple[str, ...] = evaluation.VOWELS) -> DataFrame:
    """Scores of segments against tiers (with file_id): one row a file and method.

    ``names`` maps phone, syllable and word to tier numbers. A phone tier scores nuclei; the others
    score boundaries and spans. Files without intervals in a tier have no row for it.
    """
    out = []

    def add(rows: DataFrame, method: str) -> None:
        out.append(rows.select("file_id", F.lit(method).alias("eval_method"), "TP", "Ins", "Del", "Sub", "TER"))

    for name, idx in names.items():
        tier = tiers.filter(F.col("tier_idx") == idx)
        own = segments.join(tier.select("file_id").distinct(), "file_id", "left_semi")
        if name == "phone":
            spans = evaluation.vocalic_intervals(tier, vowels).select("file_id", "xmin", "xmax")
            peaks = own.select("file_id", F.col("segment_id").alias("ord"), F.col("peak").alias("t"))
            add(evaluation.evaluate_nuclei(peaks, spans, tolerance), "nuclei")
            continue
        ref = evaluation.syllable_intervals(tier).select("file_id", F.col("xmin").alias("start"), F.col("xmax").alias("end"), "active")
        bounds = evaluation.evaluate_boundaries(evaluation.boundary_set(own), evaluation.boundary_set(ref, key=("file_id", "active")), tolerance)
        add(bounds, f"{name}_boundaries")
        add(segmentation.evaluate_spans(own, ref, tolerance), f"{name}_spans")
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    return rows


def run_evaluation(spark: SparkSession, audio_paths: str | list[str], annotation_path: str, names: dict[str, int], tolerance: float = evaluation.TOLERANCE, strip: str | None = None, **segment: Any) -> DataFrame:
    """Read, pair, segment and score a corpus: EVAL rows with the file's stem as file_id."""
    waves = audio.read_audio(spark, audio_paths).filter("success")
    tiers = pair_waves(waves, annotations.read_tiers(spark, annotation_path), strip)
    segments = segment_audio(waves.join(tiers.select("file_id").distinct(), "file_id", "left_semi"), fail=False, **segment).cache()
    rows = evaluate_segmentation(segments, tiers, names, tolerance)
    named = waves.select(F.col("file_id").alias("_f"), stem(F.col("path")).alias("_stem"))
    return rows.join(named, F.col("file_id") == F.col("_f")).select(F.col("_stem").alias("file_id"), "eval_method", "TP", "Ins", "Del", "Sub", "TER")
