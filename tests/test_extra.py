"""Triples, resampled windows, targets of balancing, motifs by tier, and files of tracks and cells."""

import numpy as np
import pytest

from plectra.operators import apa, balancing, motifs, norm, tracks, triples
from plectra.sources import features_text, matrix_files

TRIPLE = "chr long, x1 long, x2 long, x3 long"


def fused(points, tolerance):
    out, centre, seen = [], None, None
    for p in sorted(points):
        if centre and all(abs(a - b) < tolerance for a, b in zip(p, centre, strict=True)):
            seen = [s | {v} for s, v in zip(seen, p, strict=True)]
            centre = tuple(sum(s) // len(s) for s in seen)
        else:
            out += [centre] if centre else []
            centre, seen = p, [{v} for v in p]
    return sorted(out + [centre])


@pytest.mark.parametrize("spread", [300, 5_000_000])
def test_triples_are_fused_in_order(spark, spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, spread, (80, 3))
    points = [tuple(int(v) for v in b + rng.integers(0, 25, 3)) for b in base for _ in range(5)]
    df = spark.createDataFrame([(1, *p) for p in points], TRIPLE).repartition(3)
    got = sorted((r.x1, r.x2, r.x3) for r in triples.without_duplicates(df).collect())
    assert got == fused(points, 20)
    assert triples.without_duplicates(df.limit(0)).count() == 0


def test_cubes_over_both_limits(spark):
    rows = [(1, 0, 40, 80)] * 9 + [(1, 10, 40, 80)] * 6 + [(1, 0, 50, 90)] * 2 + [(1, 0, 10, 80)] * 20
    got = triples.dense_cubes(spark.createDataFrame(rows, TRIPLE), 10, 2).collect()
    assert [(r.c1, r.c2, r.c3, r.n) for r in got] == [(0, 4, 8, 9)]


def test_windows_are_resized(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 9, (3, 3)).astype(float)
    cells = [(1, 1, 5, 9, int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)]
    found = spark.createDataFrame(cells, "chr1 long, chr2 long, m1 long, m2 long, i long, j long, counts double")
    at = np.minimum(np.arange(6) / 2, 2)
    along = np.array([[np.interp(x, range(3), row) for x in at] for row in m])
    want = np.array([[np.interp(x, range(3), col) for x in at] for col in along.T]).T
    got = np.zeros((6, 6))
    for r in apa.enlarged(found, 3, 2).collect():
        got[r.i, r.j] = r.counts
    assert np.allclose(got, want)
    small = np.zeros((2, 2))
    for r in apa.resized(found, 3, 2).collect():
        small[r.i, r.j] = r.counts
    assert np.allclose(small, want.reshape(2, 3, 2, 3).max(axis=(1, 3)))


def test_rows_follow_a_target(spark):
    rng = np.random.default_rng(5)
    m = np.triu(rng.integers(1, 30, (8, 8)))
    c = spark.createDataFrame([(1, 1, 10, int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double")
    target = spark.createDataFrame([(10, 1, k, float(k)) for k in range(8)], "bin_size long, chr long, bin long, value double")
    vector = balancing.scale(c, target, 1e-5)
    assert [r.bin for r in vector.where("isnan(value)").collect()] == [0]
    sums = {r.bin: r.value for r in norm.row_sums(norm.normalize(c, vector)).collect()}
    shares = np.array([sums[k] / k for k in range(1, 8)])
    assert sorted(sums) == list(range(1, 8)) and np.allclose(shares, shares[0], rtol=1e-4)


def test_motifs_by_tier_and_direction(spark):
    loops = spark.createDataFrame([(1, 1000, 2000, 1, 9000, 9500), (1, 1500, 2500, 1, 50000, 51000), (1, 9000, 9400, 1, 30000, 30500)], "chr1 long, start1 long, end1 long, chr2 long, start2 long, end2 long")
    anchors = motifs.loop_anchors(loops, 800)
    found = {(r.x1, r.x2): (r.upstream, r.downstream) for r in anchors.collect()}
    assert found == {(1000, 2500): (True, False), (8850, 9650): (True, True), (29850, 30650): (False, True), (50000, 51000): (False, True)}
    peaks = spark.createDataFrame([(1, 1100, 1200, 5.0), (1, 2100, 2200, 6.0), (1, 9100, 9200, 7.0), (1, 30000, 30100, 8.0), (1, 50100, 50200, 1.0)], "chr long, x1 long, x2 long, score double")
    listed = [(1, 1110, 1120, 2.0, True), (1, 1130, 1140, 3.0, False), (1, 2110, 2120, 1.0, True), (1, 9110, 9120, 4.0, True), (1, 9120, 9130, -1.0, True), (1, 30010, 30020, 5.0, False), (1, 50110, 50120, -2.0, False)]
    named = spark.createDataFrame(listed, "chr long, x1 long, x2 long, score double, strand boolean")
    tier = spark.createDataFrame([(1, 9000, 9150), (1, 50000, 60000)], "chr long, x1 long, x2 long")
    unique = motifs.unique_motifs(anchors, peaks, [], named).collect()
    assert sorted(r.x1 for r in unique) == [9110, 30010]
    assert [r.x1 for r in motifs.unique_motifs(anchors, peaks, [tier], named).collect()] == [9110]
    # Of the two best motifs at the upstream anchor one is forward; it is the one inferred.
    inferred = motifs.inferred_motifs(anchors, peaks, named).collect()
    assert [(r.a1, r.x1, r.strand) for r in inferred] == [(1000, 2110, True)]
    assert {(r.a1, r.x1) for r in motifs.better_motif(anchors, named).collect()} == {(1000, 1130), (8850, 9110), (29850, 30010), (50000, 50110)}


def test_wig_headers(spark):
    text = ["track type=wiggle_0", "fixedStep chrom=chr1 start=11 step=5 span=2", "1.5", "bad", "2", "", "variableStep chrom=chr2", "7 3.5", "x 1", "fixedStep chrom=chr3 start=1", "4"]
    lines = spark.createDataFrame([("a", k, t) for k, t in enumerate(text)], "file string, line long, value string")
    got = sorted((r.chr, r.start, r.end, r.value) for r in features_text.parse_wig_files(lines).collect())
    assert got == [("chr1", 10, 12, 1.5), ("chr1", 20, 22, 2.0), ("chr2", 6, 7, 3.5), ("chr3", 0, 1, 4.0)]


def test_raw_cells_are_read_from_files(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2, 3.5), (4, 5, 6.0)], "bin_x long, bin_y long, counts double").coalesce(1)
    for k, r in enumerate(matrix_files.packed_cells(cells).collect()):
        (tmp_path / f"{k}.bin").write_bytes(bytes(r.content))
    got = sorted(tuple(r) for r in matrix_files.read_cells(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 3.5), (4, 5, 6.0)]


def test_smoothing_leaves_out_what_is_not_positive(spark):
    v = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0), (1, 2, 4.0), (1, 5, 8.0)], "chr long, bin long, value double")
    got = {r.bin: r.value for r in tracks.smoothed_positive(v, 3).collect()}
    assert got == {0: 3.0, 1: 0.0, 2: 3.0, 5: 6.0}
