"""Kernels put on Spark, one sequence a group, and the registries of envelopes, features and segmenters.

A sequence is collected as one array by its key, so a kernel's task holds one file's samples or
frames at a time; a file is the unit of memory. Everything around the kernels is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import dsp, envelopes, segmenters
from voxloom.schemas import SPAN

Kernel = Callable[..., list[tuple[float, float, float]]]
SEGMENTS = "file_id long, segment_id long, start double, peak double, end double"
SIGNALS = "file_id long, idx long, t double, v double"


# ---- registries ----------------------------------------------------------------------------------


def plain(name: str) -> str:
    return name.lower().replace("-", "_")


_ALIASES = {"cls": "cls_attention", "greedycosine": "greedy_cosine", "min_cut": "mincut", "peaks": "peakdetect"}
_SEGMENTERS: dict[str, Kernel] = {}
_FEATURES: dict[str, Callable[..., np.ndarray]] = {}
_FRAME_ENVELOPES: dict[str, Callable[..., np.ndarray]] = {}
#: Features whose model gives attention: its kernel, and whether a first token stands before the frames.
_ATTENTION: dict[str, tuple[Callable[..., np.ndarray], bool]] = {}
#: Features that need a trained model, which a caller has to bring.
NEURAL = ("hubert", "sylber", "vghubert")


def segmenter_name(name: str) -> str:
    return _ALIASES.get(plain(name), plain(name))


def register_segmenter(name: str, kernel: Kernel) -> None:
    """``kernel(x, rate, **options)`` gives (start, peak, end) triples of one sequence."""
    if not callable(kernel):
        raise TypeError("a segmenter is a callable")
    _SEGMENTERS[plain(name)] = kernel
    get_segmenter.cache_clear()


def list_segmenters() -> list[str]:
    return sorted(_SEGMENTERS)


def list_segmenter_aliases() -> dict[str, str]:
    return dict(_ALIASES)


@lru_cache(maxsize=64)
def _bound(name: str, options: tuple) -> Kernel:
    kernel, held = _SEGMENTERS[name], dict(options)
    return lambda x, rate: kernel(x, rate, **held)


@lru_cache(maxsize=64)
def get_segmenter(name: str, *options: tuple[str, Any]) -> Kernel:
    name = segmenter_name(name)
    if name not in _SEGMENTERS:
        raise ValueError(f"unknown segmenter: {name}; there are {', '.join(list_segmenters())}")
    return _bound(name, options)


def clear_segmenter_cache() -> int:
    size = _bound.cache_info().currsize
    _bound.cache_clear()
    get_segmenter.cache_clear()
    return size


def cache_info() -> dict[str, int]:
    info = _bound.cache_info()
    return {"size": info.currsize, "hits": info.hits, "misses": info.misses}


def register_features(name: str, kernel: Callable[..., np.ndarray], attention: Callable[..., np.ndarray] | None = None, *, has_cls_token: bool = True) -> None:
    """``kernel(samples, sr, **options)`` gives frames x dimensions.

    ``attention(samples, sr, **options)`` gives the model's raw weights, heads x tokens x tokens, where
    it has any; ``has_cls_token`` says that a token of its own stands before the frames.
    """
    short = feature_name(name)
    _FEATURES[short] = kernel
    if attention is None:
        _ATTENTION.pop(short, None)
    else:
        _ATTENTION[short] = attention, has_cls_token


def release_features(name: str) -> None:
    """Forget a registered extractor and the model that it holds."""
    _FEATURES.pop(feature_name(name), None)
    _ATTENTION.pop(feature_name(name), None)


def supports_attention(name: str) -> bool:
    return feature_name(name) in _ATTENTION


def get_attention(name: str) -> Callable[..., np.ndarray]:
    """``kernel(samples, sr, **options)`` that gives frames x heads."""
    short = feature_name(name)
    if short not in _ATTENTION:
        if short in NEURAL and short not in _FEATURES:
            raise RuntimeError(f"{short} needs a model: register one with register_features({short!r}, kernel, attention)")
        raise RuntimeError(f"{name} gives no attention: register it with register_features(name, kernel, attention)")
    kernel, has_cls_token = _ATTENTION[short]
    return lambda x, sr, **o: segmenters.frame_attention(kernel(x, sr, **o), has_cls_token)


def feature_name(name: str) -> str:
    short = name.lower().replace("-", "").replace("_", "")
    return "melspectrogram" if short in ("mel", "melspec", "melspectrogram") else short


def get_features(name: str) -> Callable[..., np.ndarray]:
    short = feature_name(name)
    if short in _FEATURES:
        return _FEATURES[short]
    if short in envelopes.KERNELS:  # an envelope is one column
        return lambda x, sr, **o: np.asarray(envelopes.envelope(short, x, sr, **o)[0])[:, None]
    if short in NEURAL:
        raise RuntimeError(f"{short} needs a model: register one with register_features({short!r}, kernel)")
    raise ValueError(f"unknown features: {name}")


def list_features() -> list[str]:
    return sorted({*_FEATURES, *NEURAL})


def list_envelopes() -> list[str]:
    return sorted([*envelopes.KERNELS, *_FRAME_ENVELOPES])


# ---- the kernels by name -------------------------------------------------------------------------


def ssm_envelope(x: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Row means of the shifted cosine self-similarity; a file's frames x frames at a time."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    total, low = np.zeros(len(x)), np.inf
    for at in range(0, len(x), 2048):
        s = unit[at : at + 2048] @ unit.T
        total[at : at + 2048], low = s.mean(axis=1), min(low, s.min())
    v = total - low + 1e-7 if len(x) else total
    return dsp.min_max(v) if normalize else v


def greedy_envelope(x: np.ndarray, norm_threshold: float = 2.6, merge_threshold: float = 0.8, smooth: float = 0.0, normalize: bool = True) -> np.ndarray:
    v = segmenters.greedy_pass(x, norm_threshold, merge_threshold)[2].astype(float)
    if smooth > 0:
        half = max(1, int(3 * smooth))
        bell = np.exp(-0.5 * (np.arange(-half, half + 1) / smooth) ** 2)
        v = dsp.moving_mean(v, bell / bell.sum())
    return dsp.min_max(v) if normalize else v


def mincut_envelope(x: np.ndarray, invert: bool = False, normalize: bool = True, **settings: float) -> np.ndarray:
    """Inner boundaries as impulses, smoothed."""
    v = np.zeros(len(x))
    v[[b for b in segmenters.dynamic_cut(x, **settings) if 0 < b < len(x)]] = 1
    kernel = np.array([0.25, 0.5, 1, 0.5, 0.25])
    v = dsp.moving_mean(v, kernel / kernel.sum()) if len(v) else v
    v = dsp.min_max(v) if normalize else v
    return 1 - v if invert else v


def attention_envelope(w: np.ndarray, quantile: float = 0.5, method: str = "max", normalize: bool = True) -> np.ndarray:
    """Importance over time of frames x heads: max, sum (union_strength) or mean (mean_important) of the weights that reach their head's quantile."""
    on = w >= np.quantile(w, quantile, axis=0)
    held, count = np.where(on, w, 0.0), on.sum(axis=1)
    made = {"max": lambda: np.where(on, w, -np.inf).max(axis=1), "union_strength": lambda: held.sum(axis=1), "mean_important": lambda: held.sum(axis=1) / np.maximum(count, 1)}
    if method not in made:
        raise ValueError(f"unknown method: {method}")
    v = np.where(count > 0, made[method](), 0.0)
    return dsp.min_max(v) if normalize else v


_FEATURES |= {"mfcc": dsp.mfcc, "melspectrogram": dsp.mel_spectrogram}
_FRAME_ENVELOPES |= {"cls_attention": attention_envelope, "feature_coherence": ssm_envelope, "greedy_cosine": greedy_envelope, "mincut": mincut_envelope}
_SEGMENTERS |= {
    "cls_attention": lambda w, rate, **o: segmenters.attention_nuclei(w, rate, **o),
    "greedy_cosine": lambda x, rate, **o: segmenters.greedy_nuclei(x, rate, **o),
    "mincut": lambda x, rate, **o: segmenters.mincut_segments(x, rate, **o),
    "peakdetect": lambda v, rate, **o: segmenters.peak_segments(v, np.arange(len(v)) / rate, **o),
}


# ---- on Spark ------------------------------------------------------------------------------------


def sequences(rows: DataFrame, order: str, *values: str, key: str = "file_id") -> DataFrame:
    """One row a key with its values as arrays in order."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_s"))
    return packed.select(key, *(F.col(f"_s.{v}").alias(v) for v in (order, *values)))


def apply_kernel(seqs: DataFrame, kernel: Callable[[dict[str, Any]], Any], schema: str, *, fail: bool = True) -> DataFrame:
    """``kernel`` on each sequence (a dict of its columns): file_id, result, success, error.

    With ``fail`` false an error becomes a row, and the job goes on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append((row["file_id"], kernel(row), True, None))
                except Exception as e:
                    if fail:
                        raise
                    out.append((row["file_id"], None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_id", "result", "success", "error"])

    return seqs.mapInPandas(run, f"file_id long, result {schema}, success boolean, error string")


def spans_of(triples: list[tuple[float, float, float]]) -> list[dict[str, float]]:
    return [{"start": float(a), "peak": float(p), "end": float(b)} for a, p, b in triples]


def explode_segments(results: DataFrame) -> DataFrame:
    rows = results.select("file_id", F.posexplode("result").alias("segment_id", "s"))
    return rows.select("file_id", F.col("segment_id").cast("long").alias("segment_id"), "s.start", "s.peak", "s.end")


def segment_frames(frames: DataFrame, method: str = "greedy_cosine", rate: float = 50.0, *, fail: bool = True, **options: Any) -> DataFrame:
    """Segments of each file's frames (file_id, frame, vec)."""
    kernel = get_segmenter(method, *sorted(options.items()))
    return explode_segments(apply_kernel(sequences(frames, "frame", "vec"), lambda r: spans_of(kernel(np.stack([np.asarray(v, float) for v in r["vec"]]), rate)), f"array<{SPAN}>", fail=fail))


def segment_frames_with_means(frames: DataFrame, method: str = "greedy_cosine", rate: float = 50.0, *, fail: bool = True, **options: Any) -> DataFrame:
    """Segments of each file's frames with ``embedding``, the mean of a segment's frames, from one pass over the file."""
    kernel = get_segmenter(method, *sorted(options.items()))

    def run(r: dict[str, Any]) -> list[dict[str, Any]]:
        x = np.stack([np.asarray(v, float) for v in r["vec"]])
        return [{"start": float(a), "peak": float(p), "end": float(b), "embedding": m.tolist()} for (a, p, b), m in segmenters.spans_with_means(kernel(x, rate), x, rate)]

    results = apply_kernel(sequences(frames, "frame", "vec"), run, "array<struct<start:double,peak:double,end:double,embedding:array<double>>>", fail=fail)
    rows = results.select("file_id", F.posexplode("result").alias("segment_id", "s"))
    return rows.select("file_id", F.col("segment_id").cast("long").alias("segment_id"), "s.*")


def segment_signal(signal: DataFrame, method: str = "peakdetect", *, fail: bool = True, **options: Any) -> DataFrame:
    """Segments of each file's envelope (file_id, idx, t, v)."""
    if segmenter_name(method) != "peakdetect":
        raise ValueError(f"{method} works on frames, not on an envelope")
    kernel = lambda r: spans_of(segmenters.peak_segments(np.asarray(r["v"], float), np.asarray(r["t"], float), **options))
    return explode_segments(apply_kernel(sequences(signal, "idx", "t", "v"), kernel, f"array<{SPAN}>", fail=fail))


def signal_of(results: DataFrame) -> DataFrame:
    rows = results.select("file_id", F.posexplode(F.arrays_zip("result.t", "result.v")).alias("idx", "s"))
    return rows.select("file_id", F.col("idx").cast("long").alias("idx"), "s.t", "s.v")


def envelope_of(waves: DataFrame, method: str = "sbs", *, fail: bool = True, **options: Any) -> DataFrame:
    """Envelopes of waveforms (file_id, sr, samples array)."""
    if method not in envelopes.KERNELS:
        raise ValueError(f"unknown envelope: {method}; there are {', '.join(envelopes.KERNELS)}")

    def kernel(r: dict[str, Any]) -> dict[str, list[float]]:
        v, t = envelopes.envelope(method, np.asarray(r["samples"], float), int(r["sr"]), **options)
        return {"t": np.asarray(t, float).tolist(), "v": np.asarray(v, float).tolist()}

    return signal_of(apply_kernel(waves.select("file_id", "sr", "samples"), kernel, "struct<t:array<double>,v:array<double>>", fail=fail))


def envelope_of_frames(frames: DataFrame, method: str, rate: float = 50.0, *, fail: bool = True, **options: Any) -> DataFrame:
    """Envelopes drawn from frames: feature_coherence, greedy_cosine, mincut, or cls_attention on weights of heads."""
    make = _FRAME_ENVELOPES.get(plain(method))
    if make is None:
        raise ValueError(f"unknown frame envelope: {method}; there are {', '.join(_FRAME_ENVELOPES)}")

    def kernel(r: dict[str, Any]) -> dict[str, list[float]]:
        v = make(np.stack([np.asarray(x, float) for x in r["vec"]]), **options)
        return {"t": (np.arange(len(v)) / rate).tolist(), "v": np.asarray(v, float).tolist()}

    return signal_of(apply_kernel(sequences(frames, "frame", "vec"), kernel, "struct<t:array<double>,v:array<double>>", fail=fail))


def extract(waves: DataFrame, method: str = "mfcc", *, attention: bool = False, fail: bool = True, **options: Any) -> DataFrame:
    """A registered extractor on waveforms: file_id, result (frames x dimensions, or frames x heads), success, error."""
    make = get_attention(method) if attention else get_features(method)
    kernel = lambda r: [np.asarray(x, float).tolist() for x in make(np.asarray(r["samples"], float), int(r["sr"]), **options)]
    return apply_kernel(waves.select("file_id", "sr", "samples"), kernel, "array<array<double>>", fail=fail)


def frames_of(results: DataFrame) -> DataFrame:
    rows = results.select("file_id", F.posexplode("result").alias("frame", "vec"))
    return rows.withColumn("frame", F.col("frame").cast("long"))


def features_of(waves: DataFrame, method: str = "mfcc", *, fail: bool = True, **options: Any) -> DataFrame:
    """Frames (file_id, frame, vec) of waveforms by a registered extractor."""
    return frames_of(extract(waves, method, fail=fail, **options))


def attention_of(waves: DataFrame, method: str, *, fail: bool = True, **options: Any) -> DataFrame:
    """Weights (file_id, frame, vec of one weight a head) of waveforms by a registered extractor with attention."""
    return frames_of(extract(waves, method, attention=True, fail=fail, **options))


def evaluate_spans(predicted: DataFrame, reference: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Best assignment of spans by overlap in each file: TP, Ins, Del, Sub and TER.

    Deleted references take part at cost 1 and their pairs count neither way. Other pairs are hits
    if both ends are within ``tolerance``, else substitutions, even without overlap.
    """
    span = lambda rows, active: rows.select("file_id", F.struct("start", "end", active.alias("active")).alias("s"))
    a = span(predicted, F.lit(True)).groupBy("file_id").agg(F.array_sort(F.collect_list("s")).alias("p"))
    b = span(reference, F.col("active")).groupBy("file_id").agg(F.sort_array(F.collect_list("s")).alias("r"))
    none = F.array().cast("array<struct<start:double,end:double,active:boolean>>")
    both = a.join(b, "file_id", "full").select("file_id", F.coalesce("p", none).alias("p"), F.coalesce("r", none).alias("r"))

    def kernel(row: dict[str, Any]) -> dict[str, Any]:
        p = np.array([(x["start"], x["end"]) for x in row["p"]]).reshape(-1, 2)
        ordered = sorted(row["r"], key=lambda x: not x["active"])
        r = np.array([(x["start"], x["end"]) for x in ordered]).reshape(-1, 2)
        active = np.array([bool(x["active"]) for x in ordered], bool)
        inter = np.minimum(p[:, None, 1], r[None, :, 1]) - np.maximum(p[:, None, 0], r[None, :, 0])
        hull = np.maximum(p[:, None, 1], r[None, :, 1]) - np.minimum(p[:, None, 0], r[None, :, 0])
        ratio = np.where((inter > 0) & (hull > 0), inter / np.where(hull > 0, hull, 1), 0.0)
        cost = np.where(active[None], 1 - ratio, 1.0)
        i, j = segmenters.assign(cost) if len(p) and len(r) else (np.zeros(0, int), np.zeros(0, int))
        near = (np.abs(p[i] - r[j]) <= tolerance).all(axis=1) if len(i) else np.zeros(0, bool)
        live = active[j] if len(j) else np.zeros(0, bool)
        tp, sub = int((near & live).sum()), int((~near & live).sum())
        ins, dele = len(p) - len(i), int(active.sum()) - tp - sub
        return {"TP": tp, "Ins": ins, "Del": dele, "Sub": sub, "TER": (sub + ins + dele) / max(tp + sub + dele, 1)}

    found = apply_kernel(both, kernel, "struct<TP:long,Ins:long,Del:long,Sub:long,TER:double>")
    return found.select("file_id", "result.*")
