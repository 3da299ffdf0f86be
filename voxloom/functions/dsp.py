"""Filters and spectra in NumPy, for one sequence at a time.

Conventions are stated where libraries differ: filters run both ways pad by odd reflection of three
filter lengths and start from the steady state of the first sample; spectrograms take whole frames
only, with a periodic window, unless ``center`` pads half a frame of zeros at both ends.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


def linear_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Recursive filter in blocks: within a block the response is a matrix product, between blocks a state.

    ``state`` is the transposed direct form's; ``x`` may have several columns.
    """
    n = max(len(a), len(b))
    b = np.concatenate([b, np.zeros(n - len(b))]) / a[0]
    a = np.concatenate([a, np.zeros(n - len(a))]) / a[0]
    x = np.asarray(x, np.float64)
    cols = x.reshape(len(x), -1)
    if n == 1:
        return (b[0] * cols).reshape(x.shape)
    step = np.zeros((n - 1, n - 1))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(n - 2)
    inject = b[1:] - a[1:] * b[0]
    size = min(BLOCK, max(len(x), 1))
    power = [np.eye(n - 1)]
    for _ in range(size):
        power.append(power[-1] @ step)
    observe = np.stack([p[0] for p in power[:size]])  # what the state adds to each output
    impulse = np.concatenate([[b[0]], observe[: size - 1] @ inject])
    lags = np.arange(size)[:, None] - np.arange(size)[None]
    within = np.where(lags >= 0, impulse[np.maximum(lags, 0)], 0.0)
    carry = np.stack([power[size - 1 - k] @ inject for k in range(size)], axis=1)
    z = np.zeros((n - 1, cols.shape[1])) if state is None else np.asarray(state, float).reshape(n - 1, -1) * np.ones((1, cols.shape[1]))
    out = np.empty_like(cols)
    for at in range(0, len(cols), size):
        part = cols[at : at + size]
        m = len(part)
        out[at : at + m] = within[:m, :m] @ part + observe[:m] @ z
        z = power[m] @ z + carry[:, size - m :] @ part
    return out.reshape(x.shape)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state that a constant input of 1 keeps."""
    n = max(len(a), len(b))
    b = np.concatenate([b, np.zeros(n - len(b))]) / a[0]
    a = np.concatenate([a, np.zeros(n - len(a))]) / a[0]
    if n == 1:
        return np.zeros(0)
    step = np.zeros((n - 1, n - 1))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - step, b[1:] - a[1:] * b[0])


Section = tuple[np.ndarray, np.ndarray]


def zero_phase(sections: list[Section], x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards with filters in series."""
    x = np.asarray(x, float)
    pad = 3 * sum(max(len(a), len(b)) - 1 for b, a in sections)
    if len(x) <= pad:
        raise ValueError(f"the signal must be longer than {pad} samples")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        for b, a in sections:
            y = linear_filter(b, a, y, steady_state(b, a) * y[0])
        y = y[::-1]
    return y[pad : len(y) - pad] if pad else y


def butterworth(order: int, cutoff: float) -> list[Section]:
    """Low-pass of ``order`` with its half-power point at ``cutoff``, a fraction of half the sample rate.

    Pairs of poles are sections of their own: one polynomial would lose its digits at low cutoffs.
    """
    warped = 4 * np.tan(np.pi * cutoff / 2)
    angles = np.pi * (2 * np.arange(1, (order + 1) // 2 + 1) + order - 1) / (2 * order)
    out = []
    for p in warped * np.exp(1j * angles):
        z = (4 + p) / (4 - p)
        if abs(p.imag) < 1e-12 * warped:
            gain, a, zeros = (-p / (4 - p)).real, np.array([1.0, -z.real]), np.array([1.0, 1.0])
        else:
            gain, a, zeros = abs(p) ** 2 / abs(4 - p) ** 2, np.array([1.0, -2 * z.real, abs(z) ** 2]), np.array([1.0, 2.0, 1.0])
        out.append((gain * zeros, a))
    return out


def analytic_magnitude(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal along the last axis."""
    n = x.shape[-1]
    if not n:
        return np.abs(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1))


def hamming(n: int, periodic: bool = False) -> np.ndarray:
    if n == 1:
        return np.ones(1)
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def framed(x: np.ndarray, length: int, hop: int, center: bool = False) -> np.ndarray:
    """Overlapping frames, one a row."""
    x = np.pad(x, length // 2) if center else x
    if len(x) < length:
        x = np.pad(x, (0, length - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def moving_mean(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Centred convolution of the input's length."""
    return np.convolve(x, weights, mode="same") if len(x) >= len(weights) else np.convolve(weights, x, mode="full")[(len(weights) - 1) // 2 :][: len(x)]


def min_max(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    span = np.ptp(x) if len(x) else 0.0
    return (x - x.min()) / span if span > 0 else np.zeros_like(x)


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` (last axis) at ``n`` points over the same time, by cutting or padding its spectrum."""
    m = x.shape[-1]
    if not m or n == m:
        return x[..., :n]
    spectrum = np.fft.rfft(x, axis=-1)
    keep = min(n, m) // 2 + 1
    return np.fft.irfft(spectrum[..., :keep], n, axis=-1) * (n / m)


# ---- mel and cepstral features -------------------------------------------------------------------


def hz_to_mel(f: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz (15 mels), logarithmic above (27 steps to 6400 Hz)."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) * 27 / np.log(6.4))


def mel_to_hz(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_filters(sr: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles of unit area, equally spaced in mels."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high or sr / 2), n_mels + 2))
    bins = np.fft.rfftfreq(n_fft, 1 / sr)
    up = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_power(x: np.ndarray, sr: int, n_fft: int, hop: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Frames x mels: power spectra of centred Hann frames under mel filters."""
    power = np.abs(np.fft.rfft(framed(np.asarray(x, float), n_fft, hop, center=True) * hann(n_fft), axis=1)) ** 2
    return power @ mel_filters(sr, n_fft, n_mels, low, high).T


def decibels(power: np.ndarray, reference: float = 1.0, floor: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(reference, 1e-10))
    return np.maximum(db, db.max() - floor) if db.size else db


def cosine_transform(x: np.ndarray, n: int) -> np.ndarray:
    """First ``n`` coefficients of the orthonormal type-2 transform along the last axis."""
    m = x.shape[-1]
    basis = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(m)[None] + 1) / (2 * m)) * np.sqrt(2 / m)
    basis[0] /= np.sqrt(2)
    return x @ basis.T


def slopes(x: np.ndarray, order: int = 1, width: int = 9) -> np.ndarray:
    """Derivative over frames (rows) of a polynomial of ``order`` fitted to ``width`` frames; the ends use the outermost fits."""
    half = width // 2
    if len(x) < width:
        return np.zeros_like(x)
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))  # coefficients from samples
    windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=0)  # frames, columns, samples
    factor = float(np.prod(np.arange(1, order + 1)))
    out = np.empty_like(x, dtype=float)
    out[half : len(x) - half] = windows @ fit[order] * factor
    out[:half], out[len(x) - half :] = out[half], out[len(x) - half - 1]
    return out


def mfcc(x: np.ndarray, sr: int, n_mfcc: int = 13, n_fft: int = 400, hop: int = 320, n_mels: int = 40, deltas: bool = False) -> np.ndarray:
    base = cosine_transform(decibels(mel_power(x, sr, n_fft, hop, n_mels)), n_mfcc)
    return np.concatenate([base, slopes(base, 1), slopes(base, 2)], axis=1) if deltas else base


def mel_spectrogram(x: np.ndarray, sr: int, n_mels: int = 80, n_fft: int = 400, hop: int = 320, low: float = 0.0, high: float | None = None) -> np.ndarray:
    power = mel_power(x, sr, n_fft, hop, n_mels, low, high)
    return decibels(power, float(power.max()) if power.size else 1.0)
