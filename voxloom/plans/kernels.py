"""Queries of the operators that SQL cannot express: kernels by sequence, clusterings, windows in time."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import segmenters
from voxloom.operators import discovery, segmentation
from voxloom.plans.catalog import predicted, query, reference
from voxloom.plans.views import Views
from voxloom.streaming import windows

RATE = 16


def waves(v: Views) -> DataFrame:
    """Each user's event values as a waveform of 16 samples a second."""
    rows = segmentation.sequences(v.signal().select("file_id", "idx", "v"), "idx", "v")
    return rows.select("file_id", F.lit(RATE).alias("sr"), F.col("v").alias("samples"))


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n), 6) for n in names})


def envelope(method: str, v: Views, **options: float) -> DataFrame:
    return rounded(segmentation.envelope_of(waves(v), method, **options), "t", "v")


def cepstra(method: str, v: Views, **options: int) -> DataFrame:
    rows = segmentation.features_of(waves(v), method, **options)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6)))


query("rms")(partial(envelope, "rms", frame_length=16, hop_length=4))
query("hilbert")(partial(envelope, "hilbert"))
query("lowpass")(partial(envelope, "lowpass", cutoff=1.0))
query("sbs")(partial(envelope, "sbs", nfft=16, window_length=16, step=4, pivot_freq=3.0))
query("theta")(partial(envelope, "theta", minfreq=0.5, maxfreq=6.0, bands=6, resample_rate=100))
query("mfcc")(partial(cepstra, "mfcc", n_fft=32, hop=8, n_mels=8, n_mfcc=6, deltas=True))
query("melspec")(partial(cepstra, "mel", n_fft=32, hop=8, n_mels=8))


@query("peakdetect")
def peakdetect(v: Views) -> DataFrame:
    return segmentation.segment_signal(v.signal(), delta=5.0, lookahead=1, min_syllable_dur=3600.0, merge_tol=21_600.0, onset=3600.0)


@query("greedy_cosine")
def greedy_cosine(v: Views) -> DataFrame:
    return segmentation.segment_frames(v.frames(), "greedy_cosine", 50.0, norm_threshold=0.5, merge_threshold=0.2)


@query("mincut_fixed")
def mincut_fixed(v: Views) -> DataFrame:
    return segmentation.segment_frames(v.frames(), "mincut", 50.0)


@query("mincut_dynamic")
def mincut_dynamic(v: Views) -> DataFrame:
    return segmentation.segment_frames(v.frames(), "mincut", 50.0, dynamic=True)


@query("cosine_merge")
def cosine_merge(v: Views) -> DataFrame:
    return segmentation.segment_frames(v.frames(), "mincut", 50.0, merge_threshold=0.3)


for _kind in ("feature_coherence", "greedy_cosine", "mincut"):

    @query(f"frame_envelope_{_kind}")
    def frame_envelope(v: Views, kind: str = _kind) -> DataFrame:
        options = {"norm_threshold": 0.5} if kind == "greedy_cosine" else {}
        return rounded(segmentation.envelope_of_frames(v.frames(), kind, **options), "v")


@query("chunk_trace")
def chunk_trace(v: Views) -> DataFrame:
    seqs = segmentation.sequences(v.frames(), "frame", "vec")
    rows = segmentation.apply_kernel(seqs, lambda r: segmenters.chunk_trace(np.stack([np.asarray(x, float) for x in r["vec"]])).tolist(), "array<double>")
    return rounded(rows.select("file_id", F.posexplode("result").alias("frame", "v")), "v")


@query("span_eval_hungarian")
def span_eval(v: Views) -> DataFrame:
    return rounded(segmentation.evaluate_spans(predicted(v), reference(v), 3600.0), "TER")


def vectors(v: Views) -> DataFrame:
    rows = v.frames()
    return rows.select("file_id", F.col("frame").alias("segment_id"), F.col("vec").alias("embedding"))


@query("kmeans")
def kmeans(v: Views) -> DataFrame:
    rows = vectors(v)
    return discovery.KMeansDiscovery(10).fit(rows).predict(rows).select("file_id", "segment_id", "cluster_label")


@query("minibatch_kmeans")
def minibatch_kmeans(v: Views) -> DataFrame:
    rows = vectors(v)
    return discovery.MiniBatchKMeansDiscovery(10, batch_size=256).fit(rows).predict(rows).select("file_id", "segment_id", "cluster_label")


@query("agglomerative")
def agglomerative(v: Views) -> DataFrame:
    rows = vectors(v)
    return discovery.AgglomerativeDiscovery(10).fit(rows).predict(rows).select("file_id", "segment_id", "cluster_label")


@query(
    "windowed_levels",
    """SELECT user_id AS file_id, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end",
    round(sqrt(avg(value * value)), 6) AS rms, max(value) AS peak, count(*) AS n FROM events GROUP BY ALL""",
    views=False,
)
def windowed_levels(v: Views) -> DataFrame:
    events = v.table("events").select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    return rounded(windows.windowed_levels(events, "1 day"), "rms").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(
    "session_windows",
    """WITH c AS (SELECT user_id AS file_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY ts) AS g FROM c)
    SELECT file_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY file_id, g""",
    views=False,
)
def session_windows(v: Views) -> DataFrame:
    events = v.table("events").select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"))
    return windows.sessions(events, "12 hours").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
