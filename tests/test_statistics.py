"""Statistics files merged by the rules of their lines; pixels near bins without a value."""

import numpy as np

from plectra.operators import models, stats


def _merged(spark, *files):
    rows = [(line,) for f in files for line in f]
    return {r.statistic: r.value for r in stats.merge_statistics(spark.createDataFrame(rows, "value string")).collect()}


def test_rules_of_lines(spark):
    a = ["Total Unique: 1,200 (60.00%)", "L-I-O-R Convergence: 900", "Pair Type %(L-I-O-R): 25% - 25% - 25% - 25%", "Library Complexity Estimate: 5,000", "hi-c contacts: 7", "Short Range (<20Kb): 9", "Total Duplicates: N/A"]
    b = ["Total Unique: 300", "L-I-O-R Convergence: 1,100", "Pair Type %(L-I-O-R): 25% - 25% - 25% - 25%", "Hi-C Contacts: 5: 6", "Hi-C Contacts: many", "nothing", ""]
    assert _merged(spark, a, b) == {"n_unique": 1500, "convergence": 1100, "pair_percents": 25, "n_contacts": 7}
    assert _merged(spark, a, b, ["Pair Type %(L-I-O-R): 26% - 25% - 25% - 24%"])["pair_percents"] == -1
    assert _merged(spark) == {}


def test_lines_are_read_as_they_were_written(spark, sf_dir):
    from plectra.plans import fixtures as fx
    from plectra.plans.q_pairs import _with_frags

    table = stats.pair_statistics(_with_frags(spark, fx.pairs(spark, sf_dir)), (1, 30))
    for row in table.collect():
        one = stats.merge_statistics(stats.statistics_lines(table.where(f"threshold = {row.threshold}")))
        got = {r.statistic: r.value for r in one.collect()}
        assert got.pop("pair_percents") in (25, -1) and got and all(row[k] == v for k, v in got.items())
        assert set(got) == {c for c in row.asDict() if c in dict(stats.LINES)}


def test_pixels_near_bins_without_a_value(spark):
    chroms = spark.createDataFrame([(1, 1000), (2, 95)], "idx long, len long")
    vectors = spark.createDataFrame([(1, k, float("nan") if k == 70 else 1.0) for k in range(100) if k != 30] + [(2, k, 2.0) for k in range(9)], "chr long, bin long, value double")
    bad = {(r.chr, r.bin) for r in models.bins_without_value(vectors, chroms, 10).collect()}
    assert bad == {(1, 30), (1, 70), (2, 9)}
    rng = np.random.default_rng(2)
    pixels = sorted({(1, int(a), int(b)) for a, b in rng.integers(0, 100, (200, 2))} | {(2, 1, 3), (2, 4, 4), (2, 3, 8)})
    got = models.loop_low_coverage(spark.createDataFrame(pixels, "chr long, i long, j long"), models.bins_without_value(vectors, chroms, 10)).collect()
    want = [p for p in pixels if not any(c == p[0] and (abs(k - p[1]) <= 5 or abs(k - p[2]) <= 5) for c, k in bad)]
    assert sorted((r.chr, r.i, r.j) for r in got) == want
