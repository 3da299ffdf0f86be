"""NumPy kernels against plain forms, invariants and known values."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.functions import dsp, envelopes, segmenters

RNG = np.random.default_rng(5)


def test_filter_blocks_equal_the_recursion():
    sections = dsp.butterworth(4, 0.1)
    b, a = np.polymul(sections[0][0], sections[1][0]), np.polymul(sections[0][1], sections[1][1])
    x = RNG.normal(size=700)
    plain = np.zeros_like(x)
    for n in range(len(x)):
        plain[n] = sum(b[k] * x[n - k] for k in range(5) if n >= k) - sum(a[k] * plain[n - k] for k in range(1, 5) if n >= k)
    assert np.allclose(dsp.linear_filter(b, a, x), plain)


def test_butterworth_has_unit_gain_and_half_power():
    for order in (3, 4):
        at = lambda w, order=order: np.prod([abs(np.polyval(b, np.exp(1j * w)) / np.polyval(a, np.exp(1j * w))) for b, a in dsp.butterworth(order, 0.3)])
        assert at(0.0) == pytest.approx(1) and at(0.3 * np.pi) == pytest.approx(np.sqrt(0.5))


def test_zero_phase_keeps_constants_and_refuses_short_input():
    sections = dsp.butterworth(4, 0.2)
    assert np.allclose(dsp.zero_phase(sections, np.full(50, 3.0)), 3.0)
    with pytest.raises(ValueError):
        dsp.zero_phase(sections, np.ones(12))


def test_hilbert_of_a_tone_is_its_amplitude():
    t = np.arange(1000) / 1000
    v, times = envelopes.hilbert(2 * np.sin(2 * np.pi * 50 * t), 1000)
    assert np.allclose(v, 2, atol=1e-9) and times[-1] == 1.0


@pytest.mark.parametrize("name", ["rms", "hilbert", "lowpass", "sbs", "theta"])
def test_envelopes_follow_amplitude(name):
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 440 * t) * (0.55 - 0.45 * np.cos(2 * np.pi * 4 * t))
    v, times = envelopes.envelope(name, x, 16000)
    assert len(v) == len(times) and np.isfinite(v).all() and v.min() >= -1e-6
    if name != "theta":
        want = np.interp(times, t, 0.55 - 0.45 * np.cos(2 * np.pi * 4 * t))
        assert np.corrcoef(v, want)[0, 1] > 0.8


def test_lowpass_of_a_clip_shorter_than_the_padding():
    v, t = envelopes.lowpass(np.array([1.0, -2.0, 3.0]), 16000)
    assert len(v) == len(t) == 3
    with pytest.raises(ValueError):
        envelopes.envelope("gammatone", np.zeros(3), 16000)


def test_swing_delays():
    # fixed values, read from the published table: rows Q = .1, .5, 1; columns f
    assert [envelopes.swing_delay(f, 0.1) for f in (1, 2, 3, 15, 16)] == [72, 34, 22, 1, 0]
    assert [envelopes.swing_delay(f, 0.5) for f in (1, 5, 8)] == [157, 30, 18]
    assert [envelopes.swing_delay(f, 1.0) for f in (1, 2, 5, 20)] == [191, 95, 37, 8]


def test_mfcc_shapes_and_slopes():
    x = RNG.normal(size=16000)
    assert dsp.mfcc(x, 16000).shape == (51, 13) and dsp.mfcc(x, 16000, deltas=True).shape == (51, 39)
    line = np.arange(30.0)[:, None] * [[2.0, -1.0]]
    assert np.allclose(dsp.slopes(line), [[2.0, -1.0]]) and np.allclose(dsp.slopes(line, 2), 0)
    assert dsp.mel_spectrogram(x, 16000).max() == pytest.approx(0)


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_assignment_is_of_least_cost(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 6, (n, m)).astype(float)
    i, j = segmenters.assign(cost)
    assert len(i) == min(n, m) and len(set(i)) == len(i) and len(set(j)) == len(j)
    small = cost if n <= m else cost.T
    best = min(sum(small[r, c] for r, c in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
    assert cost[i, j].sum() == pytest.approx(best)


def test_peak_scan_and_segments():
    t = np.arange(0, 2, 0.01)
    v = 1 - np.cos(2 * np.pi * 4 * t)
    tops, dips = segmenters.peak_scan(v, 0.1, 2)
    assert all(v[k] == pytest.approx(2, abs=0.01) for k in tops) and all(v[k] == pytest.approx(0, abs=0.01) for k in dips)
    found = segmenters.peak_segments(v, t, delta=0.1)
    assert len(found) >= 6 and all(a < p < b for a, p, b in found)
    capped = segmenters.peak_segments(v, t, delta=0.1, max_syllable_dur=0.2)
    assert len(capped) <= len(found)
    assert segmenters.peak_segments(np.zeros(50), t[:50]) == [] and segmenters.peak_segments(np.zeros(0), np.zeros(0)) == []
    with pytest.raises(ValueError):
        segmenters.peak_segments(np.zeros(3), np.zeros(4))


def test_greedy_on_blocks_and_silence():
    a, b = np.zeros((10, 8)), np.zeros((10, 8))
    a[:, 0], b[:, 1] = 3, 3
    spans = segmenters.greedy_segments(np.concatenate([a, b, np.zeros((5, 8)), a]))
    assert spans.tolist() == [[0, 10], [10, 20], [25, 35]]
    assert segmenters.greedy_segments(np.full((30, 4), 0.05)).shape == (0, 2)
    x = RNG.normal(size=(120, 64))
    spans = segmenters.greedy_segments(x * 3)
    assert (spans[:, 0] < spans[:, 1]).all() and (spans[1:, 0] >= spans[:-1, 1]).all()
    with pytest.raises(ValueError):
        segmenters.greedy_segments(np.zeros(3))


def brute_cut(s, k, low, high):
    """All splits into k - 1 segments by enumeration."""
    n, best = len(s), (np.inf, None)

    def cost(j, i):
        inner = s[j:i, j:i].sum()
        outer = s[j:i].sum() + s[:, j:i].sum() - 2 * inner
        return outer / (outer + inner + 1e-5)

    def go(at, left, so_far, cuts):
        nonlocal best
        if left == 0:
            if at == n and so_far < best[0] - 1e-12:
                best = so_far, cuts
            return
        for i in range(at + low, min(n, at + high - 1) + 1):
            go(i, left - 1, so_far + cost(at, i), [*cuts, i])

    go(0, k - 1, 0.0, [0])
    return best


@pytest.mark.parametrize("seed", range(4))
def test_fixed_cut_is_optimal(seed):
    s = segmenters.similarity(np.random.default_rng(seed).normal(size=(14, 5)))
    cuts = segmenters.fixed_cut(s, 4, 2, 9)
    assert cuts[0] == 0 and cuts[-1] == 14
    assert cuts == brute_cut(s, 4, 2, 9)[1]


@pytest.mark.parametrize(("n", "seed", "delta"), [(100, 42, 0.0033), (50, 13, 0.0028), (200, 77, 0.0019)])
def test_dynamic_cut_invariants(n, seed, delta):
    x = np.random.default_rng(seed).standard_normal((n, 48)).astype(np.float32)
    cuts = segmenters.dynamic_cut(x, delta=delta)
    assert cuts[0] == 0 and cuts[-1] == n and cuts == sorted(set(cuts))
    cost, back, units = segmenters.chunk_tables(x)
    q, h = 30, 7
    part = x[q - h : q].astype(float)
    assert cost[h, q] == pytest.approx(((part - part.mean(axis=0)) ** 2).sum(axis=0).mean(), rel=1e-6)
    assert segmenters.dynamic_cuts(x, [delta, 1e9], [0.75, 0.75])[0] == cuts
    with pytest.raises(ValueError):
        segmenters.dynamic_cuts(x, [delta], [0.1, 0.2])


def test_merging_stops_at_two():
    x = np.ones((12, 3))
    assert segmenters.merge_similar([(0, 4), (4, 8), (8, 12)], x, 0.5) == [(0, 8), (8, 12)]
    assert segmenters.merge_similar([(0, 6), (6, 12)], x, 0.5) == [(0, 6), (6, 12)]


def test_spans_as_envelope():
    v = segmenters.spans_as_envelope(np.array([[2, 5]]), 8)
    assert v.tolist() == [0, 0, 1, 1, 1, 0, 0, 0]
    assert segmenters.spans_as_envelope(np.array([[2, 5]]), 8, "boundary_density").argmax() == 2
    with pytest.raises(ValueError):
        segmenters.spans_as_envelope(np.zeros((0, 2)), 8, "other")
