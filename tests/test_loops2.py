"""Second generation of loop calls, clusters and differences of loops against brute force."""

import math

import numpy as np
import pytest

from plectra.kernels import peaks
from plectra.operators import models


def test_upper_tails_of_small_and_large_means():
    rng = np.random.default_rng(1)
    k, lam = rng.integers(0, 400, 300), rng.uniform(0.01, 300, 300)
    got = peaks.upper_tails(k, lam)
    for a, b, p in zip(k, lam, got, strict=True):
        below = math.fsum(math.exp(-b + n * math.log(b) - math.lgamma(n + 1)) for n in range(a))
        above = math.fsum(math.exp(-b + n * math.log(b) - math.lgamma(n + 1)) for n in range(a, a + 2000)) if a > b else 1 - below
        assert math.isclose(p, above, rel_tol=1e-9, abs_tol=1e-9)
    odd = peaks.upper_tails(np.array([0, 3, 3, 3, 50_000]), np.array([0.0, 0.0, np.nan, np.inf, 50_000.0]))
    assert odd[0] == 1 and odd[1] == 0 and np.isnan(odd[2:4]).all() and 0.49 < odd[4] < 0.51
    assert peaks.upper_tails(np.array([], int), np.array([])).size == 0


@pytest.mark.parametrize("seed", range(5))
def test_clusters_take_pixels_in_order(seed):
    rng = np.random.default_rng(seed)
    x, y, o = rng.integers(0, 3000, 60), rng.integers(0, 3000, 60), rng.integers(0, 9, 60).astype(float)
    rest, want = list(np.lexsort((y, x, -o))), []
    while rest:
        m, cx, cy, reach = [rest[0]], int(x[rest[0]]), int(y[rest[0]]), 250.0
        for k in rest[1:]:
            if math.hypot(x[k] - cx, y[k] - cy) <= reach:
                m.append(k)
                cx, cy = sum(int(x[p]) for p in m) // len(m), sum(int(y[p]) for p in m) // len(m)
                reach = 250 + round(max(math.hypot(x[p] - cx, y[p] - cy) for p in m))
        rest = [k for k in rest if k not in m]
        want.append(([int(p) for p in m], cx, cy, int(reach)))
    assert [c[:4] for c in peaks.clusters(x, y, o, 250)] == want


def test_thresholds_of_benjamini_and_hochberg(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(0, 0.0005, 60), rng.uniform(0, 1, 2000)])
    rows = [(1, k, k, 1.0, *[int(k % 2)] * 4, *[float(v)] * 4) for k, v in enumerate(p)]
    rows += [(1, -1, 5, 1.0, 7, 7, 7, 7, 0.9, 0.9, 0.9, float("nan"))]
    columns = ["chr long, i long, j long, observed double", *(f"row_{m} long" for m in peaks.MASKS), *(f"p_{m} double" for m in peaks.MASKS)]
    tested = spark.createDataFrame(rows, ", ".join(columns))
    thresholds = models.loop_thresholds(tested, 0.1)
    got = {(r.mask, r.row): r.threshold for r in thresholds.collect()}
    called = set()
    for row in (0, 1):
        own = np.sort(p[row::2])
        good = np.flatnonzero(own <= np.arange(1, len(own) + 1) / len(own) * 0.1)
        most = own[good[-1]]
        called |= {k for k in range(row, len(p), 2) if p[k] <= most}
        assert all(math.isclose(got[m, row], (good[-1] + 1) / len(own) * 0.1) for m in peaks.MASKS)
    assert got["bl", 7] == 0 and ("v", 7) not in got and len(called) > 30
    assert {r.i for r in models.loop_significant(tested, thresholds).collect()} == called


def test_loops_that_the_other_map_has_not(spark):
    at = "chr long, i long, j long"
    own = spark.createDataFrame([(1, 10, 20), (1, 50, 90), (1, 70, 99), (2, 10, 20), (1, 5, 9)], at)
    other = spark.createDataFrame([(1, 11, 21), (1, 53, 90)], at)
    cells = spark.createDataFrame([(1, 1, 10, 50, 90, 5.0), (1, 1, 10, 70, 99, 9.0)], "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double")
    kernel = spark.createDataFrame([(1, 50, 90, 5.0, 4.0, 4.0, 4.0, 4.0), (1, 70, 99, 9.0, 9.0, 9.0, 9.0, 4.0)], f"{at}, observed double, bl double, donut double, h double, v double")
    found = models.loop_difference(own, other, kernel, cells, 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 5, 9), (1, 50, 90), (2, 10, 20)]


def test_a_loop_needs_pixels_or_low_rates(spark):
    rows = [(1, 1, 5, 20.0, 5.0, 5.0, 5.0, 5.0, 0.01, 0.0, 0.0, 0.0), (1, 60, 70, 20.0, 5.0, 5.0, 5.0, 5.0, 0.1, 0.1, 0.0, 0.0), (1, 30, 40, 30.0, 5.0, 5.0, 5.0, 5.0, 0.1, 0.1, 0.0, 0.0), (1, 31, 40, 9.0, 8.0, 8.0, 8.0, 8.0, 0.1, 0.1, 0.0, 0.0)]
    columns = "chr long, i long, j long, observed double, bl double, donut double, h double, v double, fdr_bl double, fdr_donut double, fdr_h double, fdr_v double"
    got = models.loop_calls(spark.createDataFrame(rows, columns), 10, 20, fdr_sum=0.02).collect()
    assert sorted((r.i, r.j, r.pixels) for r in got) == [(1, 5, 1), (30, 40, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_islands_cluster_like_the_whole_chromosome(spark, seed):
    """Chains of pixels let clusters grow out of their first islands."""
    rng = np.random.default_rng(seed)
    spots = [(int(a), int(a) + int(b), int(o)) for a, b, o in zip(rng.integers(0, 900, 120), rng.integers(0, 12, 120), rng.integers(1, 30, 120), strict=True)]
    chain = [(1000, 1000 + 2 * k, 60 - k) for k in range(10)] + [(1009, 1010, 5)]
    rows = sorted({(c, i, j): (c, i, j, float(o)) for c in (1, 2) for i, j, o in spots + chain}.values())
    got = models.loop_coalesce(spark.createDataFrame(rows, "chr long, i long, j long, observed double"), 10, 30).collect()
    want = []
    for c in (1, 2):
        i, j, o = (np.array(v) for v in list(zip(*[r for r in rows if r[0] == c], strict=True))[1:])
        want += [(c, k.x + 5, k.y + 5, k.radius, len(k.members), o[k.members[0]]) for k in peaks.clusters(i * 10, j * 10, o, 30)]
    assert sorted((r.chr, r.x, r.y, r.radius, r.pixels, r.observed) for r in got) == sorted(want)
    assert max(w[4] for w in want) > 10  # the last pixel is farther off along x than two circles reach
