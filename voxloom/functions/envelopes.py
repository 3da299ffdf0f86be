"""Amplitude envelopes of one waveform: each gives values and times of equal length."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from voxloom.functions import dsp

Envelope = tuple[np.ndarray, np.ndarray]


def rms(x: np.ndarray, sr: int, *, frame_length: int = 1024, hop_length: int = 256) -> Envelope:
    v = np.sqrt((dsp.framed(np.asarray(x, float), frame_length, hop_length, center=True) ** 2).mean(axis=1))
    return v, np.arange(len(v)) * hop_length / sr


def hilbert(x: np.ndarray, sr: int) -> Envelope:
    return dsp.analytic_magnitude(np.asarray(x, float)), np.linspace(0, len(x) / sr, len(x))


def lowpass(x: np.ndarray, sr: int, *, cutoff: float = 5, order: int = 4) -> Envelope:
    """Rectified and low-passed both ways; a moving mean where the signal is too short for that."""
    x, times = np.abs(np.asarray(x, float)), np.linspace(0, len(x) / sr, len(x))
    if len(x) > 3 * order:
        return dsp.zero_phase(dsp.butterworth(order, cutoff / (sr / 2)), x), times
    n = min(max(5, int(0.01 * sr)), len(x))
    return (dsp.moving_mean(x, np.full(n, 1 / n)) if n > 1 else x), times


def band_subtraction(x: np.ndarray, sr: int, *, nfft: int = 256, window_length: int = 256, step: int = 160, pivot_freq: float = 3000, smoothing_window_samples: int = 7) -> Envelope:
    """Energy below the pivot less energy above it, not below 0, smoothed and scaled to a maximum of 1."""
    window = dsp.hamming(window_length, periodic=True)
    frames = dsp.framed(np.asarray(x, float), window_length, step)
    frames = frames - frames.mean(axis=1, keepdims=True)
    size = np.abs(np.fft.rfft(frames * window, nfft, axis=1)) / window.sum()
    pivot = int(np.ceil(pivot_freq / (sr / nfft)))
    v = np.maximum(size[:, 1:pivot].sum(axis=1) - size[:, pivot : nfft // 2].sum(axis=1), 0)
    smooth = dsp.hamming(smoothing_window_samples)
    v = dsp.zero_phase([(smooth, np.ones(1))], v) if len(v) > 3 * (len(smooth) - 1) else dsp.moving_mean(v, smooth / smooth.sum())
    times = (np.arange(len(v)) * step + window_length / 2) / sr + nfft / sr / 2
    return (v / v.max() if v.max() > 0 else v), times


def gammatone_bands(x: np.ndarray, sr: int, *, bands: int = 20, minfreq: float = 50, maxfreq: float = 7500, resample_rate: int = 1000) -> Envelope:
    """Bands x time: magnitudes behind fourth-order gammatone filters at geometric centre frequencies."""
    n = len(x)
    f = np.fft.rfftfreq(max(n, 1), 1 / sr)
    centres = np.geomspace(minfreq, maxfreq, bands)
    width = 1.019 * 24.7 * (4.37e-3 * centres + 1)
    gain = (1 + 1j * (f[None] - centres[:, None]) / width[:, None]) ** -4
    out = np.fft.irfft(np.fft.rfft(np.asarray(x, float))[None] * gain, n, axis=1) if n else np.zeros((bands, 0))
    v = dsp.fourier_resample(dsp.analytic_magnitude(out), int(np.ceil(n * resample_rate / sr)))
    return v, np.linspace(0, n / sr, v.shape[1])


@cache
def swing_delay(f: int, q: float) -> int:
    """Steps of 1 ms from an impulse to the damped oscillator's greatest swing, less one."""
    b, dt = 2 * np.pi * f, 1e-3
    x = v = top = at = 0.0
    for t in range(2_000):
        v += ((1.0 if t == 0 else 0.0) - x - v / (b * q)) * b * b * dt
        x += v * dt
        if x <= top:
            break
        top, at = x, t
    return int(at)


def theta(x: np.ndarray, sr: int, *, f: float = 5, Q: float = 0.5, N: int = 10, **bands: float) -> Envelope:
    """Sonority from damped oscillators driven by gammatone bands, put back by their delay.

    Where the delay is zero, nothing is put back.
    """
    drive, _ = gammatone_bands(x, sr, **bands)
    n = drive.shape[1]
    if not n:
        return np.zeros(0), np.zeros(0)
    q, rate = min(max(round(Q * 10), 1), 10) / 10, min(max(round(f), 1), 20)
    # position and speed, each step: v += (drive - x - c v) / m dt, then x += v dt
    w, dt = 2 * np.pi * f, 1e-3
    damp, pull = 1 - w / Q * dt, w * w * dt
    # eliminating v: x[t] = (1 + damp - pull dt) x[t-1] - damp x[t-2] + pull dt drive[t]
    wide = np.concatenate([drive, np.zeros((len(drive), 500))], axis=1)
    wide[:, 0] = 0
    swing = dsp.linear_filter(np.array([pull * dt, 0.0, 0.0]), np.array([1.0, -(1 + damp - pull * dt), damp]), wide.T)
    late = swing_delay(rate, q)
    swing = np.concatenate([swing[late:], np.zeros((late, swing.shape[1]))])[:n]
    level = np.log10(swing - swing.min() + 1e-5)
    top = np.sort(level, axis=1)[:, -min(N, level.shape[1]) :].sum(axis=1)
    return dsp.min_max(top), np.linspace(0, len(x) / sr, n)


KERNELS: dict[str, Callable[..., Envelope]] = {"rms": rms, "hilbert": hilbert, "lowpass": lowpass, "sbs": band_subtraction, "theta": theta}


def envelope(name: str, x: np.ndarray, sr: int, **options: float) -> Envelope:
    if name not in KERNELS:
        raise ValueError(f"unknown envelope: {name}; there are {', '.join(KERNELS)}")
    return KERNELS[name](x, sr, **options)
