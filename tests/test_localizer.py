"""Peaks around features: kernels against plain loops, features that only the second try resolves, rows of nulls."""

import math

import numpy as np
import pytest

from plectra.kernels import peaks as K
from plectra.operators.localizer import localize


def _plain_blur(m, radius):
    n, k = m.shape
    return np.array([[np.mean([m[min(max(i + a, 0), n - 1), min(max(j + b, 0), k - 1)] for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]) for j in range(k)] for i in range(n)])


def test_blurs_repeat_the_border():
    m = np.random.default_rng(0).poisson(4, (9, 9)).astype(float)
    assert np.allclose(K.box_blur(m, 2), _plain_blur(m, 2)) and np.allclose(K.box_blur(m, 0), m)
    assert np.allclose(K.gauss_blur(m, 1), _plain_blur(_plain_blur(m, 1), 1))


@pytest.mark.parametrize("sigma", range(1, 12))
def test_boxes_come_near_the_variance(sigma):
    widths = [2 * r + 1 for r in K.box_radii(sigma)]
    assert len(set(widths)) <= 2 and max(widths) - min(widths) in (0, 2) and widths == sorted(widths)
    step = (4 * min(widths) + 4) / 12
    assert 0 <= sum(w * w - 1 for w in widths) / 12 - sigma**2 < max(step, 1e-9)


def _plain_peaks(raw, normed, window, max_p):
    n = len(raw)
    observed = np.rint(_plain_blur(raw, window) * (2 * window + 1) ** 2)
    smooth = normed
    for r in K.box_radii(window):
        smooth = _plain_blur(smooth, r)
    smooth = smooth * observed.sum() / smooth.sum()
    expected = observed / smooth
    expected *= observed.sum() / expected.sum()
    z = 2 * (np.sqrt(observed) - np.sqrt(expected))
    top = [(i, j) for i in range(window, n - window) for j in range(window, n - window) if z[i, j] == z[max(0, i - window) : i + window + 1, max(0, j - window) : j + window + 1].max()]

    def tail(o, e):
        return 1 - sum(math.exp(k * math.log(e) - e - math.lgamma(k + 1)) for k in range(int(o)))

    ranked = sorted((tail(observed[c], expected[c]) * len(top), -z[c], *c) for c in top)
    return [(i, j, observed[i, j], p) for p, _, i, j in ranked if p <= max_p]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_peaks_by_plain_loops(window):
    rng = np.random.default_rng(window)
    raw = rng.poisson(2, (17, 17)).astype(float)
    raw[8:11, 6:9] += 9
    normed = raw / np.outer(rng.uniform(0.7, 1.3, 17), rng.uniform(0.7, 1.3, 17))
    got, want = K.local_peaks(raw, normed, window, 1.0), _plain_peaks(raw, normed, window, 1.0)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)
    assert abs(got[0][0] - 9) <= window and abs(got[0][1] - 7) <= window


def test_ties_have_one_peak():
    flat = np.full((15, 15), 3.0)
    found = K.local_peaks(flat, flat, 2, float("inf"))
    assert found == K.local_peaks(flat, flat, 2, float("inf"))
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 2 for a in found for b in found if a != b)
    assert K.local_peaks(flat * 0, flat * 0, 2, 1.0) == []


def test_second_tries_and_nulls(spark):
    rng = np.random.default_rng(11)
    n, radius = 500, 6
    m = np.triu(rng.poisson(2, (n, n))).astype(float)
    spots = [(20 + 40 * k, 250 + 20 * k + (3 if k % 2 else 0)) for k in range(11)]
    for k, (a, b) in enumerate(spots):
        m[a - 2 : a + 3, b - 2 : b + 3] += rng.poisson(min(8, 0.3 * k), (5, 5))
    m[440:470, 20:60] = 0
    bias = rng.uniform(0.8, 1.2, n)
    cells = spark.createDataFrame([(1, 1, 100, int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double")
    vectors = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(bias)], "chr long, bin long, value double")
    places = spots + [(200, 20)]  # nothing is stored below the diagonal
    rows = [(1, a * 100 - 300, a * 100 + 300, 1, b * 100 - 300, b * 100 + 300) for a, b in places]
    features = spark.createDataFrame(rows * 2, "chr1 long, start1 long, end1 long, chr2 long, start2 long, end2 long")
    got = {}
    for r in localize(cells, features, 100, vectors, window=1, peaks=2).collect():
        got.setdefault(((r.start1 + 300) // 100, (r.start2 + 300) // 100), []).append((r.rank, r.window, r.local_x, r.local_y, r.observed, r.p))
    normed, tried = m / np.outer(bias, bias), []
    assert set(got) == set(places)
    for a, b in places:
        for window in (1, 2):
            h = radius + window
            part = np.s_[a - h : a + h + 1, b - h : b + h + 1]
            want = K.local_peaks(m[part], normed[part], window, 0.05)[:2] if b > a else []
            if want:
                break
        tried.append(window if want else None)
        found = sorted(got[a, b], key=lambda r: r[0] or 0)
        if not want:
            assert found == [(None,) * 6]
            continue
        assert [f[:5] for f in found] == [(k + 1, window, (a - h + i) * 100, (b - h + j) * 100, o) for k, (i, j, o, _) in enumerate(want)]
        assert np.allclose([f[5] for f in found], [w[3] for w in want])
    assert {1, 2, None} <= set(tried), tried


def test_radius_of_features(spark):
    """A radius under LEAST_RADIUS counts as that, none as the side; without cells and features there are no rows but nulls."""
    at = "chr1 long, start1 long, end1 long, chr2 long, start2 long, end2 long, radius double"
    cells = spark.createDataFrame([(1, 1, 500, 14, 24, 40.0)], "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double")
    rows = [(1, 5000, 5500, 1, 10000, 10500, 700.0), (1, 5000, 5500, 1, 10000, 10500, None), (1, 5000, 5500, 1, 10000, 10500, 700.0)]
    got = localize(cells, spark.createDataFrame(rows, at), 500, max_p=1e9).collect()
    assert sorted((r.local_x or 0, r.local_y or 0) for r in got)[0] == (0, 0) and len(got) == 2
    assert localize(cells, spark.createDataFrame([], at), 500).count() == 0
    assert [r.rank for r in localize(cells.limit(0), spark.createDataFrame(rows[:1], at), 500).collect()] == [None]
