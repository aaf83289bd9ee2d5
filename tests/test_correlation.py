"""Tiled correlation and iterated eigenvectors against the dense kernel."""

import dense_twin
import numpy as np
import pytest

from plectra.operators import correlation as C

COLUMNS = "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, value double"


def matrix(seed, n, empty=()):
    rng = np.random.default_rng(seed)
    half = np.where(np.arange(n) < n // 2, 1, -1)
    m = np.triu(np.exp(0.4 * np.outer(half, half) + 0.3 * rng.standard_normal((n, n))) * (rng.random((n, n)) < 0.8))
    m[list(empty)] = 0
    m[:, list(empty)] = 0
    return m + np.triu(m, 1).T


@pytest.fixture(scope="module")
def maps(spark):
    ms = {1: matrix(1, 40, (3, 17)), 2: matrix(2, 23)}
    rows = [(c, c, 10, int(i), int(j), float(m[i, j])) for c, m in ms.items() for i, j in np.argwhere(np.triu(m))]
    oe = spark.createDataFrame(rows, COLUMNS).coalesce(2)
    return ms, oe, spark.createDataFrame([(1, 400), (2, 230)], "idx long, len long")


@pytest.mark.parametrize("tile", [7, 512])
def test_tiles(maps, tile):
    ms, oe, chroms = maps
    got = C.pearson(oe, chroms, tile).collect()
    for c, m in ms.items():
        due = dense_twin.pearson(m)
        own = {(r.i, r.j): r.value for r in got if r.chr == c}
        assert set(own) == {(i, j) for i, j in np.argwhere(~np.isnan(due)).tolist() if i <= j}
        for (i, j), v in own.items():
            assert abs(v - due[i, j]) < 1e-9


@pytest.mark.parametrize("which", [0, 1])
def test_eigenvectors(maps, which):
    ms, oe, chroms = maps
    if which:
        ms, oe = {2: ms[2]}, oe.where("chr1 = 2")
    got = C.eigenvector(oe, chroms, which, centred=False).collect()
    for c, m in ms.items():
        due = dense_twin.eigenvector(dense_twin.pearson(m), which)
        own = {r.bin: r.value for r in got if r.chr == c}
        assert set(own) == set(np.flatnonzero(~np.isnan(due)).tolist())
        np.testing.assert_allclose([own[b] for b in sorted(own)], due[~np.isnan(due)], atol=1e-6)


def test_empty(spark, maps):
    _, oe, chroms = maps
    assert C.pearson(oe.where("false"), chroms).collect() == [] and C.eigenvector(oe.where("false"), chroms).collect() == []
