"""Named recipes of segmentation, features and pooling."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

#: Published settings.
RECIPES: dict[str, dict[str, Any]] = {
    "sylber": {"segmentation": "greedy_cosine", "features": "sylber", "pooling": "mean", "segmentation_kwargs": {"norm_threshold": 2.6, "merge_threshold": 0.8}},
    "vg_hubert_mincut": {"segmentation": "mincut", "features": "vghubert", "pooling": "mean", "segmentation_kwargs": {"sec_per_syllable": 0.22, "bounded": True, "min_hop": 3, "max_hop": 50}},
    "vg_hubert_cls": {"segmentation": "cls_attention", "features": "vghubert", "pooling": "mean", "feature_kwargs": {"mode": "word"}},
}
#: Segmenters with published settings: envelope or features, method, and their options.
SEGMENTERS: dict[str, dict[str, Any]] = {
    "sbs_peakdetect": {"envelope": "sbs", "method": "peakdetect", "envelope_kwargs": {"pivot_freq": 3000, "smoothing_window_samples": 7}, "kwargs": {"delta": 0.01, "max_syllable_dur": 0.4, "amplitude_ratio_tol": 0.4}},
    "theta_oscillator": {"envelope": "theta", "method": "peakdetect", "envelope_kwargs": {"f": 5, "Q": 0.5, "N": 8}, "kwargs": {"delta": 0.025, "lookahead": 1}},
    "sylber": {"features": "sylber", "method": "greedy_cosine", "kwargs": {"norm_threshold": 2.6, "merge_threshold": 0.8}},
    "vg_hubert_mincut": {"features": "vghubert", "method": "mincut", "kwargs": {"sec_per_syllable": 0.20, "merge_threshold": 0.3, "bounded": False}},
    "vg_hubert_cls": {"features": "vghubert", "method": "cls_attention", "kwargs": {"quantile": 0.9}},
}
PARTS = ("segmentation_kwargs", "feature_kwargs", "pooling_kwargs")


def list_presets() -> list[str]:
    return sorted(RECIPES)


def list_segmenter_presets() -> list[str]:
    return sorted(SEGMENTERS)


def segmenter_preset(name: str) -> dict[str, Any]:
    """A segmenter's method, envelope or features, and options for ``api.segment_audio``."""
    if name not in SEGMENTERS:
        raise ValueError(f"unknown segmenter preset: {name}; there are {', '.join(list_segmenter_presets())}")
    return deepcopy(SEGMENTERS[name])


def get_preset(name: str) -> dict[str, Any]:
    if name not in RECIPES:
        raise ValueError(f"unknown preset: {name}; there are {', '.join(list_presets())}")
    return {**{p: {} for p in PARTS}, **deepcopy(RECIPES[name])}


def resolve_preset(name: str | None, *, segmentation: str | None = None, features: str | None = None, pooling: str | None = None, **kwargs: dict[str, Any]) -> dict[str, Any]:
    """The recipe with options merged in; a segmentation, features or pooling that differs from it is an error.

    Without a name, greedy_cosine on sylber features with mean pooling is the default.
    """
    given = {"segmentation": segmentation, "features": features, "pooling": pooling}
    if name is None:
        out = {"segmentation": "greedy_cosine", "features": "sylber", "pooling": "mean", **{p: {} for p in PARTS}}
        out |= {k: v for k, v in given.items() if v is not None}
    else:
        out = get_preset(name)
        for k, v in given.items():
            if v is not None and v != out[k]:
                raise ValueError(f"preset {name} has {k} {out[k]}, not {v}")
    for part in PARTS:
        out[part] = {**out[part], **(kwargs.get(part) or {})}
    if out["segmentation"] == "peakdetect" and not out["segmentation_kwargs"].get("envelope"):
        raise ValueError("peakdetect needs an envelope")
    return out
