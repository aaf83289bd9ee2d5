"""Hand-computed cases and properties of the numpy kernels and sequential operators."""

import math
import random

import dense_twin
import numpy as np
import pytest

from plectra.kernels import dense, peaks
from plectra.operators.expected import smoothed
from plectra.operators.stats import library_size


def test_smoothing_takes_enough_counts():
    actual, possible = np.full(50, 500.0), np.full(50, 10.0)
    assert np.allclose(smoothed(actual, possible), 50.0)
    thin = smoothed(np.full(50, 10.0), np.full(50, 10.0))
    assert np.allclose(thin[:5], 1.0)


def test_library_size():
    size = library_size(800, 200)
    assert abs(800 / size - 1 + math.exp(-1000 / size)) < 1e-3
    assert library_size(10, 0) is None


def test_pearson_of_proportional_rows():
    m = np.array([[4, 2, 0, 0], [2, 3, 0, 1], [0, 0, 0, 0], [0, 1, 0, 5]], float)
    c = dense_twin.pearson(m)
    assert np.isnan(c[2]).all() and np.allclose(np.diag(c)[[0, 1, 3]], 1)
    centred = m[[0, 1, 3]] - m.mean(axis=1)
    assert np.isclose(c[0, 1], np.corrcoef(centred)[0, 1])


def test_eigenvector_of_a_checkerboard():
    n = np.arange(6) % 2
    c = np.where(n[:, None] == n[None, :], 1.0, -1.0)
    v = dense_twin.eigenvector(c)
    assert len(set(np.sign(v[::2]))) == 1 and np.sign(v[0]) == -np.sign(v[1])


def test_components_of_two_squares():
    m = np.zeros((12, 12), bool)
    m[1:3, 1:3] = m[3, 3] = m[8:10, 8:10] = True
    labels = dense.components8(m)
    assert labels.max() == 2 and labels[1, 1] == labels[3, 3] != labels[8, 8]


def test_enrichment_of_a_flat_map_is_its_level():
    n = 60
    m = np.full((n, n), 5.0)
    i, j = np.array([20, 25]), np.array([40, 45])
    found = peaks.enrichment(m, np.full(n, 5.0), np.ones(n), i, j, 5, 2)
    for k in peaks.MASKS:
        assert np.allclose(found[k], 5.0)
    assert np.allclose(found["observed"], 5)


def test_poisson_tail():
    assert math.isclose(peaks.upper_tail(3, 2.0), 1 - math.exp(-2) * (1 + 2 + 2), rel_tol=1e-12)
    assert peaks.upper_tail(0, 1.0) == 1.0


def test_coalesce_groups_near_pixels():
    x, y, o = np.array([0, 10, 1000]), np.array([0, 0, 1000]), np.array([5.0, 9.0, 1.0])
    found = peaks.coalesce(x, y, o, 10, 20)
    assert [f[3] for f in found] == [2, 1] and found[0][4] == 9.0


@pytest.mark.parametrize("seed", range(5))
def test_interval_operators_against_brute_force(spark, seed):
    from plectra.operators import intervals as iv

    random.seed(seed)

    def some(n):
        return [(random.randrange(1, 3), s := random.randrange(0, 9000), s + random.randrange(0, 4000)) for _ in range(n)]

    a, b = some(40), some(40)
    fa, fb = (spark.createDataFrame(x, "chr long, x1 long, x2 long") for x in (a, b))
    want = {(c, max(x, u), min(y, v)) for c, x, y in a for d, u, v in b if c == d and x <= v and u <= y}
    assert {tuple(r) for r in iv.intersect(fa, fb).select("chr", "x1", "x2").collect()} == want
    merged = iv.merge(fa)
    rows = sorted(tuple(r) for r in merged.select("chr", "x1", "x2").collect())
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(rows, rows[1:], strict=False))
    assert sorted(tuple(r) for r in iv.merge(merged).select("chr", "x1", "x2").collect()) == rows


def test_balanced_rows_are_even(spark, sf_dir):
    from plectra.operators import balancing, norm
    from plectra.plans.q_maps import contacts

    cells = contacts(spark, sf_dir, sizes=(10000,))
    normed = norm.normalize(cells.where("chr1 = chr2"), balancing.scale(cells, tolerance=1e-4))
    for _, part in norm.row_sums(normed).toPandas().groupby("chr"):
        assert part["value"].std() / part["value"].mean() < 5e-3


def test_sites_that_are_no_numbers(spark):
    from plectra.sources.features_text import parse_sites

    lines = spark.createDataFrame([("1 100 x 300",), ("2",)], "value string")
    assert sorted((r.chr, r.site_idx, r.pos or -1) for r in parse_sites(lines).collect()) == [("1", 0, 100), ("1", 1, -1), ("1", 2, 300)]


def test_tables_are_stored_without_a_checkpoint_folder(spark):
    from plectra.plans.storage import stored

    assert stored(spark.range(3)).count() == 3
