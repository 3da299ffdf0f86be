"""Order-dependent segmentation of one sequence, in NumPy."""

from __future__ import annotations

import numpy as np

from voxloom.functions.dsp import min_max, moving_mean

Triple = tuple[float, float, float]
FAR = 16384.0


# ---- peaks and valleys ---------------------------------------------------------------------------


def peak_scan(v: np.ndarray, delta: float = 0.0, lookahead: int = 1) -> tuple[list[int], list[int]]:
    """Indices of maxima and minima that stand out by more than ``delta`` and hold over ``lookahead`` samples.

    The first extreme found only starts the scan and is left out.
    """
    tops, dips, order = [], [], []
    high, low, at_high, at_low, n = -np.inf, np.inf, 0, 0, len(v)
    for k in range(n - lookahead):
        x = v[k]
        if x > high:
            high, at_high = x, k
        if x < low:
            low, at_low = x, k
        ahead = v[k : k + lookahead]
        if x < high - delta and high != np.inf and ahead.max() < high:
            tops.append(at_high)
            order.append(tops)
            high = low = np.inf
            at_low = k
            if k + lookahead >= n:
                break
            continue
        if x > low + delta and low != -np.inf and ahead.min() > low:
            dips.append(at_low)
            order.append(dips)
            high = low = -np.inf
            at_high = k
            if k + lookahead >= n:
                break
    if order:
        order[0].pop(0)
    return tops, dips


def peak_segments(
    v: np.ndarray,
    t: np.ndarray,
    *,
    delta: float = 0.0,
    lookahead: int | None = None,
    min_syllable_dur: float = 0.05,
    max_syllable_dur: float | None = None,
    onset: float = 0.05,
    merge_tol: float = 0.05,
    min_amplitude_threshold: float = 0.0,
    amplitude_ratio_tol: float | None = None,
) -> list[Triple]:
    """Syllables from valley to valley around the highest peak between them."""
    v, t = np.asarray(v, float), np.asarray(t, float)
    if v.ndim != 1 or v.shape != t.shape:
        raise ValueError("envelope and times must be one-dimensional and of equal length")
    if not len(v):
        return []
    if lookahead is None:
        lookahead = max(1, int(min_syllable_dur / 2 / (t[1] - t[0] if len(t) > 1 else 0.01)))
    tops, dips = peak_scan(v, delta, lookahead)
    if not tops or not dips:
        return []
    peaks, valleys = np.array(tops), np.array(dips)
    if amplitude_ratio_tol is not None:
        after = np.searchsorted(peaks, valleys)
        padded = np.concatenate([[0.0], v[peaks], [0.0]])
        beside = np.maximum(padded[after], padded[after + 1])
        valleys = valleys[(beside <= 0) | (v[valleys] <= amplitude_ratio_tol * beside)]
    if not len(valleys):
        return []
    parts = np.split(valleys, np.nonzero(np.diff(t[valleys]) > merge_tol)[0] + 1)
    edges = [float(t[p[np.argmin(v[p])]]) for p in parts]
    edges = [0.0] * int(edges[0] > onset) + edges + [float(t[-1])] * int(edges[-1] < t[-1] - onset)
    least = min_amplitude_threshold * v.max() if min_amplitude_threshold > 0 else -np.inf
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        inside = peaks[(t[peaks] > a) & (t[peaks] < b)]
        if len(inside):
            top = inside[np.argmax(v[inside])]
            if b - a >= min_syllable_dur and v[top] >= least and (max_syllable_dur is None or b - a <= max_syllable_dur):
                out.append((a, float(t[top]), b))
    return out


# ---- greedy merging by cosine --------------------------------------------------------------------


def cosines(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (rows * one).sum(-1) / np.sqrt(((rows**2).sum(-1) + 1e-8) * ((one**2).sum(-1) + 1e-8))


def frame_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(-1) + 1e-8)


def greedy_pass(x: np.ndarray, norm_threshold: float = 2.6, merge_threshold: float = 0.8) -> tuple[list[list[int]], list[int], np.ndarray]:
    """One pass: spans, the spans that a split (not silence) ended, and each frame's similarity to the running mean.

    A split starts a new mean but its weight goes on counting from the last silence. Silent frames
    have similarity 0, the first ones after silence 1.
    """
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("features must be frames x dimensions")
    loud, trace = frame_norms(x) >= norm_threshold, np.zeros(len(x), np.float32)
    spans, splits, begin, weight, mean = [], [], -1, 0, None
    for k, row in enumerate(x):
        if not loud[k]:
            if begin >= 0:
                spans.append([begin, k])
            begin, weight = -1, 0
        elif weight == 0:
            begin, weight, mean, trace[k] = k, 1, row, 1.0
        else:
            like = float(cosines(mean, row))
            trace[k] = like
            if like >= merge_threshold:
                mean = (mean * weight + row) / (weight + 1)
            else:
                splits.append(len(spans))
                spans.append([begin, k])
                begin, mean = k, row
            weight += 1
    if begin >= 0:
        spans.append([begin, len(x)])
    return spans, splits, trace


def greedy_segments(x: np.ndarray, norm_threshold: float = 2.6, merge_threshold: float = 0.8) -> np.ndarray:
    """Spans of frames (n x 2): a greedy pass, then each split is undone or moved to where it parts the two means best."""
    x = np.asarray(x)
    spans, splits, _ = greedy_pass(x, norm_threshold, merge_threshold)
    gone = set()
    cuts = [spans[k][1] for k in splits]
    for k, cut in zip(splits, cuts, strict=True):
        if k + 1 >= len(spans):
            continue
        (a0, a1), (b0, b1) = spans[k], spans[k + 1]
        left, right = x[a0:a1].mean(0), x[b0:b1].mean(0)
        if cosines(left, right) >= merge_threshold:
            spans[k + 1] = [a0, b1]
            gone.add(k)
            continue
        low, high = max(a0, cut - max(1, (a1 - a0) // 2)), min(b1, cut + max(1, (b1 - b0) // 2))
        to_left, to_right = cosines(x[low:high], left), cosines(x[low:high], right)
        gain = [to_left[:i].sum() + to_right[i:].sum() for i in range(high - low)]
        spans[k][1] = spans[k + 1][0] = low + int(np.argmax(gain))
    return np.array([s for k, s in enumerate(spans) if k not in gone], dtype=np.int64).reshape(-1, 2)


def spans_as_envelope(spans: np.ndarray, n: int, method: str = "segment_mask", normalize: bool = True, smooth: int = 1) -> np.ndarray:
    v = np.zeros(n)
    if method == "segment_mask":
        for a, b in spans:
            v[max(0, int(a)) : max(0, min(n, int(b)))] = 1
    elif method in ("boundary_impulse", "boundary_density"):
        at = [int(a) for a, _ in spans if 0 <= a < n]
        v[at] = 1
        if method == "boundary_density" and smooth > 0:
            bell = np.exp(-0.5 * (np.arange(-smooth, smooth + 1) / max(1.0, smooth)) ** 2)
            v = moving_mean(v, bell / (bell.sum() + 1e-8))
    else:
        raise ValueError(f"unknown method: {method}")
    return min_max(v) if normalize and np.ptp(v) > 0 else v


# ---- minimum cut ---------------------------------------------------------------------------------


def similarity(x: np.ndarray, cosine: bool = False) -> np.ndarray:
    """Products of all frames, shifted to a minimum of 1e-7."""
    if cosine:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = x @ x.T
    return s - s.min() + 1e-7 if s.size else s


def cut_costs(s: np.ndarray, low: int, high: int) -> np.ndarray:
    """cost[i, h]: share of what joins frames i-h..i-1 to the rest, for lengths h in low..high; inf where it does not fit."""
    n = len(s)
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = s.cumsum(0).cumsum(1)
    cost = np.full((n + 1, high + 1), np.inf)
    for h in range(max(1, low), min(high, n) + 1):
        i = np.arange(h, n + 1)
        j = i - h
        inner = total[i, i] - total[j, i] - total[i, j] + total[j, j]
        rows, cols = total[i, n] - total[j, n], total[n, i] - total[n, j]
        outer = rows + cols - 2 * inner
        cost[i, h] = outer / (outer + inner + 1e-5)
    return cost


def fixed_cut(s: np.ndarray, k: int, min_hop: int = 3, max_hop: int = 50) -> list[int]:
    """``k`` boundaries from 0 to the end with the least sum of cut costs; the earliest cut on ties.

    Segments are ``min_hop`` to ``max_hop - 1`` frames. Tables are single precision.
    """
    n = len(s)
    cost = cut_costs(np.asarray(s, float), min_hop, max_hop - 1)
    best, back = np.full((n + 1, k), 100000, np.float32), np.ones((n + 1, k), np.int64)
    best[0, 0] = 0
    for i in range(min_hop, n + 1):
        starts = np.arange(max(0, i - max_hop + 1), i - min_hop + 1)
        options = best[starts, : k - 1] + cost[i, i - starts][:, None]
        pick = options.argmin(axis=0)
        best[i, 1:], back[i, 1:] = options[pick, np.arange(k - 1)], starts[pick]
    out = [n]
    for m in range(k - 1, 0, -1):
        out.append(int(back[out[-1], m]))
    return out[::-1]


def unbounded_cut(s: np.ndarray, k: int) -> list[int]:
    """The same without bounds on length, read back from the last frame; for short sequences."""
    n = len(s)
    cost = cut_costs(np.asarray(s, float), 1, n)
    best, back = np.full((n, k), 100000.0), np.ones((n, k), np.int64)
    best[0, 0] = 0
    for i in range(1, n):
        starts = np.arange(i)
        options = best[starts, : k - 1] + cost[i, i - starts][:, None]
        pick = options.argmin(axis=0)
        best[i, 1:], back[i, 1:] = options[pick, np.arange(k - 1)], starts[pick]
    out = [n - 1]
    for m in range(k - 1, 0, -1):
        out.append(int(back[out[-1], m]))
    return out[::-1]


def chunk_costs(x: np.ndarray, longest: int) -> np.ndarray:
    """cost[h, q]: squared deviation (mean over dimensions) of the h frames that end before q, for h up to ``longest``."""
    x = np.asarray(x, np.float64)
    n = len(x)
    squares = np.append(0.0, (x**2).mean(axis=1).cumsum())
    sums = np.concatenate([np.zeros((1, x.shape[1])), x.cumsum(axis=0)])
    cost = np.full((longest + 1, n + 1), FAR)
    for h in range(1, longest + 1):
        q = np.arange(h, n + 1)
        spread = squares[q] - squares[q - h] - ((sums[q] - sums[q - h]) ** 2).mean(axis=1) / h
        cost[h, q] = np.minimum(spread, FAR)
    return cost


def chunk_tables(x: np.ndarray, threshold: float = 0.2, longest: int = 35, min_hop: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Chunk costs, and the last length of the best split of each prefix into each number of chunks."""
    n = len(x)
    longest = int(min(n, max(1, longest)))
    min_hop = int(min(longest, max(1, min_hop)))
    cost, units = chunk_costs(x, longest), max(1, int(threshold * n))
    lengths = np.arange(min_hop, longest + 1)
    back = np.zeros((n + 1, units + 1), np.int64)
    before = np.full(n + 1, FAR)
    before[0] = 0.0
    q = np.arange(1, n + 1)
    for m in range(1, units + 1):
        start = q[None] - lengths[:, None]
        options = np.where(start >= 0, before[np.maximum(start, 0)], FAR) + cost[lengths[:, None], q[None]]
        pick = options.argmin(axis=0)
        back[1:, m] = lengths[pick]
        before = np.concatenate([[FAR], options[pick, q - 1]])
    return cost, back, units


def walk_back(back: np.ndarray, n: int, units: int) -> list[tuple[int, int]]:
    """(end, length) of the chunks of the best split of all frames into ``units`` chunks."""
    out, q = [], n
    for m in range(units, 0, -1):
        h = int(back[q, m]) if q > 0 else 0
        if h <= 0 or h > q:
            break
        out.append((q, h))
        q -= h
    return out


def quantile_cut(cost: np.ndarray, back: np.ndarray, n: int, units: int, delta: float, quantile: float) -> list[int]:
    """Boundaries at the last number of chunks probed whose quantile of cost a frame is above ``delta``."""
    low, high = max(1, units // 3), max(1, units)
    chosen = low
    while low <= high:
        mid = (low + high) // 2
        each = [cost[h, q] / h for q, h in walk_back(back, n, mid)]
        if (float(np.quantile(each, quantile)) if each else np.inf) > delta:
            low, chosen = mid + 1, mid
        else:
            high = mid - 1
    return sorted({0, n, *(q - h for q, h in walk_back(back, n, chosen))})


def dynamic_cut(x: np.ndarray, threshold: float = 0.2, longest: int = 35, min_hop: int = 3, delta: float = 0.0033, quantile: float = 0.75) -> list[int]:
    n = len(x)
    if not n:
        return [0]
    cost, back, units = chunk_tables(x, threshold, longest, min_hop)
    return quantile_cut(cost, back, n, units, delta, quantile) or [0, n]


def dynamic_cuts(x: np.ndarray, deltas: list[float], quantiles: list[float], **options: float) -> list[list[int]]:
    """Boundaries for each pair of settings from one table."""
    if len(deltas) != len(quantiles):
        raise ValueError("as many deltas as quantiles are needed")
    cost, back, units = chunk_tables(x, **options)
    return [quantile_cut(cost, back, len(x), units, d, q) for d, q in zip(deltas, quantiles, strict=True)]


def chunk_trace(x: np.ndarray, threshold: float = 0.2, longest: int = 35, min_hop: int = 3, method: str = "min_cost") -> np.ndarray:
    """Least or mean cost a frame of the chunks that end at each frame."""
    if method not in ("min_cost", "mean_cost"):
        raise ValueError(f"unknown method: {method}")
    n = len(x)
    if not n:
        return np.zeros(0)
    longest = int(min(n, max(1, longest)))
    lengths = np.arange(min(longest, max(1, min_hop)), longest + 1)
    each = chunk_costs(x, longest)[lengths][:, 1:] / lengths[:, None]
    return each.min(axis=0) if method == "min_cost" else each.mean(axis=0)


def merge_similar(spans: list[tuple[int, int]], x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Join the most similar neighbours by their means until none reaches ``threshold`` or two are left; fewer than 3 stay."""
    spans = list(spans)

    def like(k: int) -> float:
        a, b = (x[p:q].mean(axis=0) if q > p else np.zeros(x.shape[1]) for p, q in spans[k : k + 2])
        size = np.linalg.norm(a), np.linalg.norm(b)
        return float(a @ b / (size[0] * size[1])) if min(size) >= 1e-8 else 0.0

    while len(spans) >= 3:
        sims = [like(k) for k in range(len(spans) - 1)]
        k = int(np.argmax(sims))
        if sims[k] < threshold:
            break
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1])]
    return spans


def mincut_segments(
    x: np.ndarray,
    rate: float,
    *,
    dynamic: bool = False,
    sec_per_syllable: float = 0.2,
    merge_threshold: float | None = None,
    bounded: bool = True,
    min_hop: int = 3,
    max_hop: int = 50,
    **settings: float,
) -> list[Triple]:
    """Segments with the frame most similar to the others of its segment as nucleus."""
    x = np.asarray(x)
    n = len(x)
    if not n:
        return []
    if dynamic:
        cuts = dynamic_cut(x, min_hop=min_hop, **settings)
    else:
        k = max(2, int(np.ceil(n / rate / sec_per_syllable)) + 1)
        cuts = fixed_cut(similarity(x), k, min_hop, max_hop) if bounded else unbounded_cut(similarity(x), k)
    spans = list(zip(cuts, cuts[1:], strict=False))
    if merge_threshold is not None and not dynamic:
        spans = merge_similar(spans, x, merge_threshold)
    else:
        spans = [s for s in spans if s[1] - s[0] > 1] or spans
    like, out = similarity(x, cosine=True), []
    for a, b in spans:
        top = a + int(like[a:b, a:b].mean(axis=1).argmax()) if b - a > 1 else a
        out.append((a / rate, top / rate, b / rate))
    return out


def greedy_nuclei(x: np.ndarray, rate: float, norm_threshold: float = 2.6, merge_threshold: float = 0.8) -> list[Triple]:
    """Greedy segments in seconds with the frame nearest to the mean as nucleus."""
    x, out = np.asarray(x), []
    for a, b in greedy_segments(x, norm_threshold, merge_threshold):
        part = x[a:b]
        top = a
        if b - a > 1:
            unit = part / (np.linalg.norm(part, axis=1, keepdims=True) + 1e-8)
            mean = part.mean(axis=0)
            top = a + int((unit @ (mean / (np.linalg.norm(mean) + 1e-8))).argmax())
        out.append((a / rate, top / rate, b / rate))
    return out


def spans_with_means(spans: list[Triple], x: np.ndarray, rate: float) -> list[tuple[Triple, np.ndarray]]:
    """Each segment with the mean of its frames; a segment of no frame takes the one at its start."""
    x, out = np.asarray(x, float), []
    for a, p, b in spans:
        first = min(max(int(round(a * rate)), 0), max(len(x) - 1, 0))
        out.append(((a, p, b), x[first : max(first + 1, int(round(b * rate)))].mean(axis=0)))
    return out


# ---- attention -----------------------------------------------------------------------------------


def frame_attention(raw: np.ndarray, has_cls_token: bool = True) -> np.ndarray:
    """Heads x tokens x tokens -> frames x heads: what the first token pays each frame; without such a token what
    each frame gets from all others."""
    raw = np.asarray(raw, float)
    if raw.ndim != 3 or raw.shape[1] != raw.shape[2]:
        raise ValueError("attention must be heads x tokens x tokens")
    if has_cls_token:
        return raw[:, 0, 1:].T
    return (raw.sum(axis=1) - np.diagonal(raw, axis1=1, axis2=2)).T


def attention_nuclei(w: np.ndarray, rate: float, quantile: float = 0.9, merge_valley_tol: float = 0.0) -> list[Triple]:
    """Segments where any head's weight (frames x heads) reaches that head's quantile.

    Runs of one frame are left out unless all are such; the nucleus is the frame with the greatest
    sum over heads, the first on ties, and a segment ends at its last frame.
    """
    w = np.asarray(w, float)
    if not len(w):
        return []
    on = (w >= np.quantile(w, quantile, axis=0)).any(axis=1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    runs = edges.reshape(-1, 2)
    total = w.sum(axis=1)
    if not len(runs):  # not-a-number weights reach no quantile
        return [(0.0, int(total.argmax()) / rate, (len(w) - 1) / rate)]
    apart = np.append(True, runs[1:, 0] - runs[:-1, 1] > int(merge_valley_tol * rate + 1e-9)) if merge_valley_tol > 0 else np.ones(len(runs), bool)
    first = np.flatnonzero(apart)
    runs = np.stack([runs[first, 0], runs[np.append(first[1:], len(runs)) - 1, 1]], axis=1)
    long = runs[runs[:, 1] - runs[:, 0] > 1]
    return [(a / rate, (a + int(total[a:b].argmax())) / rate, (b - 1) / rate) for a, b in (long if len(long) else runs).tolist()]


# ---- assignment ----------------------------------------------------------------------------------


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost; shortest augmenting paths, lower rows and columns first."""
    cost = np.asarray(cost, float)
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        far, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, last = row, 0.0, -1
        while True:
            step = base + c[at] - u[at] - v
            better = ~done & (step < far)
            far[better], via[better] = step[better], last
            col = int(np.where(done, np.inf, far).argmin())
            done[col], base = True, far[col]
            if owner[col] < 0:
                break
            at, last = owner[col], col
        u[row] += base
        for k in np.nonzero(done)[0]:
            if k != col and owner[k] >= 0:
                u[owner[k]] += base - far[k]
                v[k] -= base - far[k]
        while col >= 0:
            before = via[col]
            owner[col] = row if before < 0 else owner[before]
            col = before
    cols = np.nonzero(owner >= 0)[0]
    rows = owner[cols]
    order = np.argsort(cols if flipped else rows)
    return (cols[order], rows[order]) if flipped else (rows[order], cols[order])
