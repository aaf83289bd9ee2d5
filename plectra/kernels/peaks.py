"""Local enrichment of matrix cells, thresholds by false discovery rate, and greedy clustering."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: Counts that the lower-left box gathers before it stops growing, and the largest half-width.
ENOUGH, MARGIN = 16.0, 20
#: Base of the expectation's logarithmic bins, their number, and the largest observed count of a histogram.
LOG_BASE, LAMBDAS, OBSERVED = 2**0.33, 40, 10_000
MASKS = ("bl", "donut", "h", "v")


def _table(m: np.ndarray) -> np.ndarray:
    return np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def _box(t: np.ndarray, r0, r1, c0, c1) -> np.ndarray:
    """Sums over rows r0..r1 and columns c0..c1, both included, cut at the edges; empty boxes are 0."""
    n, k = t.shape[0] - 1, t.shape[1] - 1
    r0, c0 = np.clip(r0, 0, n), np.clip(c0, 0, k)
    r1, c1 = np.clip(r1 + 1, 0, n), np.clip(c1 + 1, 0, k)
    r1, c1 = np.maximum(r0, r1), np.maximum(c0, c1)
    return t[r1, c1] - t[r0, c1] - t[r1, c0] + t[r0, c0]


def _sums(t: np.ndarray, i, j, w, p) -> dict[str, np.ndarray]:
    bl = _box(t, i + 1, i + w, j - w, j - 1) - _box(t, i + 1, i + p, j - p, j - 1)
    h = _box(t, i - 1, i + 1, j - w, j + w) - _box(t, i - 1, i + 1, j - p, j + p)
    v = _box(t, i - w, i + w, j - 1, j + 1) - _box(t, i - p, i + p, j - 1, j + 1)
    whole = _box(t, i - w, i + w, j - w, j + w) - _box(t, i - p, i + p, j - p, j + p)
    arms = _box(t, i, i, j - w, j - p - 1) + _box(t, i, i, j + p + 1, j + w) + _box(t, i - w, i - p - 1, j, j) + _box(t, i + p + 1, i + w, j, j)
    return {"bl": bl, "donut": whole - arms, "h": h, "v": v}


def enrichment(m: np.ndarray, by_distance: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, window: int, peak: int, row0: int = 0, col0: int = 0) -> dict[str, np.ndarray]:
    """Observed and the four local expectations of cells (i, j) of a normalised tile m.

    m covers rows from row0 and columns from col0; only cells above the diagonal count. The window starts at
    `window` (less near the diagonal) and grows until the lower-left box has ENOUGH raw counts.
    """
    rows, cols = np.arange(m.shape[0]) + row0, np.arange(m.shape[1]) + col0
    above = cols[None, :] > rows[:, None]
    c = np.where(above, m, 0.0)
    d = np.where(above, by_distance[np.minimum(np.abs(cols[None, :] - rows[:, None]), len(by_distance) - 1)], 0.0)
    raw = c * v[rows][:, None] * v[cols][None, :]
    tc, td, traw = _table(c), _table(d), _table(raw)
    a, b = i - row0, j - col0
    far = np.abs(j - i)
    w = np.clip(np.minimum(window, (far - 1) // 2), peak + 1, MARGIN)
    while True:
        gathered = _sums(traw, a, b, w, np.full_like(w, peak))["bl"]
        grow = (gathered < ENOUGH) & (w < MARGIN) & (2 * w < far)
        if not grow.any():
            break
        w = np.where(grow, w + 1, w)
    p = np.full_like(w, peak)
    own = by_distance[np.minimum(far, len(by_distance) - 1)] * v[i] * v[j]
    num, den = _sums(tc, a, b, w, p), _sums(td, a, b, w, p)
    out = {"observed": np.rint(m[a, b] * v[i] * v[j])}
    for k in MASKS:
        with np.errstate(invalid="ignore", divide="ignore"):
            out[k] = num[k] / den[k] * own
    return out


def lambda_bin(e: np.ndarray) -> np.ndarray:
    """Bin of an expectation: floor(ln e / ln LOG_BASE), at least 0 and at most the last; -1 for NaN or infinity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        k = np.floor(np.log(np.where(e > 0, e, 1.0)) / math.log(LOG_BASE))
    return np.where(np.isfinite(e), np.clip(k, 0, LAMBDAS - 1), -1).astype(np.int64)


def poisson_pmf(lam: float, n: int) -> np.ndarray:
    k = np.arange(n)
    logs = k * math.log(lam) - lam - np.array([math.lgamma(x + 1) for x in k])
    return np.exp(logs)


def fdr_table(hist: np.ndarray, inv_fdr: float) -> tuple[int, np.ndarray, float]:
    """(threshold, false discovery rate by observed count, total) of one row of a histogram, as its lambda asks for.

    hist[0] holds the row's lambda index; the rest are counts by observed value.
    """
    lam = 2 ** ((hist[0] + 1) / 3)
    counts = hist[1:].astype(float)
    total = counts.sum()
    width = len(counts)
    if total == 0:
        return OBSERVED, np.zeros(width), 0.0
    expected = total * poisson_pmf(lam, width)
    seen, chance = counts[::-1].cumsum()[::-1], expected[::-1].cumsum()[::-1]
    good = np.flatnonzero(inv_fdr * chance <= seen)
    good = good[seen[good] > 0]
    first = OBSERVED if not len(good) else int(good[0]) - 1 if good[0] else width - 2
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = np.where(seen > 0, chance / seen, 1.0)
    return first, rate, total


class Cluster(NamedTuple):
    """Pixels, the strongest first; the centre and radius; the span of x that the cluster's circles ever covered."""

    members: list[int]
    x: int
    y: int
    radius: int
    span: tuple[int, int]


def clusters(x: np.ndarray, y: np.ndarray, observed: np.ndarray, radius: int) -> list[Cluster]:
    """Greedy clusters of pixels.

    A cluster takes every pixel, in order of strength, within its radius of the running integer centre; after each one
    the centre is set anew and the radius is `radius` and the farthest member's distance. Ties: smaller x, then y.
    """
    rest = np.lexsort((y, x, -observed))
    out = []
    while len(rest):
        members, cx, cy, reach = [int(rest[0])], int(x[rest[0]]), int(y[rest[0]]), float(radius)
        low, high = cx - reach, cx + reach
        taken = np.zeros(len(rest), bool)
        taken[0] = True
        at = 1
        while at < len(rest):
            near = np.flatnonzero(np.hypot(x[rest[at:]] - cx, y[rest[at:]] - cy) <= reach)
            if not len(near):
                break
            k = at + int(near[0])  # pixels passed over before it are not looked at again
            taken[k] = True
            members.append(int(rest[k]))
            cx, cy = int(x[members].sum()) // len(members), int(y[members].sum()) // len(members)
            reach = radius + round(float(np.hypot(x[members] - cx, y[members] - cy).max()))
            low, high = min(low, cx - reach), max(high, cx + reach)
            at = k + 1
        rest = rest[~taken]
        out.append(Cluster(members, cx, cy, int(reach), (int(low), int(high))))
    return out


def coalesce(x: np.ndarray, y: np.ndarray, observed: np.ndarray, res: int, radius: int) -> list[tuple[int, int, int, int, float]]:
    """(middle of the centre's bin x, y, radius, pixels, observed) of greedy clusters."""
    return [(c.x + res // 2, c.y + res // 2, c.radius, len(c.members), float(observed[c.members[0]])) for c in clusters(x, y, observed, radius)]


def upper_tails(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(X >= k) of Poisson variables; NaN where the mean is not finite.

    Terms are summed from k upwards where k is over the mean, and from k - 1 downwards otherwise: both sums fall
    from their first term on.
    """
    k, lam = np.asarray(k, np.int64), np.asarray(lam, float)
    out = np.where(np.isfinite(lam), np.where(k <= 0, 1.0, 0.0), np.nan)
    at = np.flatnonzero((k > 0) & (lam > 0) & np.isfinite(lam))
    n, mean = k[at].astype(float), lam[at]
    up = n > mean
    first = np.where(up, n, n - 1)
    values, places = np.unique(first, return_inverse=True)
    factorials = np.array([math.lgamma(v + 1) for v in values])
    term = np.exp(first * np.log(mean) - mean - factorials[places]) if len(at) else first
    total, step = term.copy(), first.copy()
    live = np.flatnonzero(term > 0)
    while len(live):
        rising = up[live]
        step[live] += np.where(rising, 1.0, 0.0)
        term[live] *= np.where(rising, mean[live] / np.maximum(step[live], 1.0), step[live] / mean[live])
        step[live] -= np.where(rising, 0.0, 1.0)
        total[live] += term[live]
        live = live[term[live] > total[live] * 1e-16]
    out[at] = np.clip(np.where(up, total, 1.0 - total), 0.0, 1.0)
    return out


def upper_tail(k: int, lam: float) -> float:
    """P(X >= k) of a Poisson variable."""
    return float(upper_tails(np.array([k]), np.array([lam]))[0])


def box_blur(m: np.ndarray, radius: int) -> np.ndarray:
    """Means of squares of 2 radius + 1 cells; edges repeat the border."""
    size = 2 * radius + 1
    t = _table(np.pad(m.astype(float), radius, mode="edge"))
    return (t[size:, size:] - t[:-size, size:] - t[size:, :-size] + t[:-size, :-size]) / size**2


def box_radii(sigma: int, boxes: int = 3) -> list[int]:
    """Radii of boxes that one after the other come near a Gaussian: odd widths around the ideal one, the smaller first.

    As many have the smaller width as bring the variance, (width^2 - 1) / 12 each, nearest from above.
    """
    variance = 12 * sigma * sigma
    low = math.isqrt(variance // boxes + 1)
    low -= low % 2 == 0
    smaller = (boxes * (low + 1) * (low + 3) - variance) // (4 * low + 4)
    return [(low if k < smaller else low + 2) // 2 for k in range(boxes)]


def gauss_blur(m: np.ndarray, sigma: int) -> np.ndarray:
    for radius in box_radii(sigma):
        m = box_blur(m, radius)
    return m


def _largest_around(m: np.ndarray, reach: int) -> np.ndarray:
    for axis in (0, 1):
        pad = [(reach, reach) if k == axis else (0, 0) for k in (0, 1)]
        m = np.lib.stride_tricks.sliding_window_view(np.pad(m, pad, constant_values=-1), 2 * reach + 1, axis).max(-1)
    return m


def local_peaks(raw: np.ndarray, normed: np.ndarray, window: int, max_p: float) -> list[tuple[int, int, float, float]]:
    """(row, column, observed, p) of a map's peaks, the most significant first; of equal ones the higher score, then row order.

    Observed are the contacts within `window` of a cell. Expected is the bias of a place: observed over the normalised map, blurred, with as
    many contacts in all. A peak has the highest 2 (sqrt observed - sqrt expected) within `window`, ties by coins with a fixed seed; p is its
    Poisson tail times the number of peaks. Cells within `window` of the border are compared with, but are no peaks.
    """
    observed = np.rint(box_blur(raw, window) * (2 * window + 1) ** 2)
    smooth = gauss_blur(normed, window)
    total = observed.sum()
    if total <= 0 or smooth.sum() <= 0:
        return []
    smooth = smooth * (total / smooth.sum())
    known = smooth > 1e-9 * smooth.max()
    observed = np.where(known, observed, 0.0)
    expected = np.where(known, observed / np.where(known, smooth, 1.0), 0.0)
    if expected.sum() <= 0:
        return []
    expected *= total / expected.sum()
    score = 2 * (np.sqrt(observed) - np.sqrt(expected))
    coins = np.random.default_rng(0).random(score.shape)
    order = np.empty(score.size, np.int64)
    order[np.lexsort((coins.ravel(), np.round(score, 9).ravel()))] = np.arange(score.size)
    order = order.reshape(score.shape)
    peak = (order == _largest_around(order, window)) & (observed > 0)
    inside = np.zeros_like(peak)
    inside[window : len(raw) - window, window : len(raw) - window] = True
    i, j = np.nonzero(peak & inside)
    p = upper_tails(observed[i, j].astype(np.int64), expected[i, j]) * len(i)
    ranked = sorted((float(p[k]), -float(score[i[k], j[k]]), int(i[k]), int(j[k]), float(observed[i[k], j[k]])) for k in range(len(i)) if p[k] <= max_p)
    return [(a, b, o, q) for q, _, a, b, o in ranked]
