"""Intervals that overlap in crowds: results of plain loops, without rows for the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from plectra.operators import intervals as I
from plectra.operators import motifs as MO

LOCI = "chr long, x1 long, x2 long"


def made(n, seed, starts, longest, scores=None):
    rng = random.Random(seed)
    rows = [(1 + k % 2, x := rng.randint(-50, starts), x + rng.randint(0, longest)) for k in range(n)]
    return [(*r, rng.choice(scores)) for r in rows] if scores else rows


def overlap(a, b):
    return a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]


@pytest.fixture
def joined(monkeypatch):
    """Counts the rows of all overlap joins."""
    rows, join = [], I.overlap_join

    def counting(*args, **more):
        out = join(*args, **more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(I, "overlap_join", counting)
    return rows


@pytest.mark.parametrize("starts", [60, 4000])
def test_best_of_a_crowd(spark, joined, starts):
    a, b = made(300, 1, starts, 70, [1.0, 2.0, 2.5, None]), made(150, 2, starts, 90)
    got = {tuple(r) for r in I.retain_best(spark.createDataFrame(b, LOCI), spark.createDataFrame(a, LOCI + ", score double")).collect()}
    want = {max((m for m in a if overlap(m, at)), key=lambda m: (m[3] or 0, -m[1], -m[2]), default=None) for at in b}
    assert got == want - {None}
    assert sum(joined) <= len(a) + len(b)


@pytest.mark.parametrize("starts", [60, 4000])
def test_single_and_several_motifs_of_a_locus(spark, joined, starts):
    a, b = made(300, 3, starts, 30, [1.0, 2.0]), made(150, 4, starts, 40)
    base, motifs = spark.createDataFrame(b, LOCI), spark.createDataFrame(a + a[:5], LOCI + ", score double")
    hits = {at: [m for m in a + a[:5] if overlap(m, at)] for at in b}
    assert {tuple(r) for r in I.retain_unique(base, motifs).collect()} == {m for found in hits.values() if len(found) == 1 for m in found}
    assert {tuple(r) for r in I.retain_multi(base, motifs).collect()} == {m for found in hits.values() if len(found) > 1 for m in found}
    assert sum(joined) <= 2 * (len(a) + len(b))


@pytest.mark.parametrize("starts", [60, 4000])
def test_overlaps_of_crowds(spark, joined, starts):
    a, b = made(300, 5, starts, 25) * 3, made(200, 6, starts, 60) * 3
    got = sorted(tuple(r) for r in I.intersect(spark.createDataFrame(a, LOCI), spark.createDataFrame(b, LOCI)).collect())
    want = {(x[0], max(x[1], y[1]), min(x[2], y[2])) for x in set(a) for y in set(b) if overlap(x, y)}
    assert got == sorted(want)
    assert sum(joined) <= 4 * len(want)


def test_common_stretches_need_no_pairs(spark, joined):
    a, b = made(200, 7, 500, 9), made(200, 8, 500, 9)
    got = I.common(spark.createDataFrame(a, LOCI), spark.createDataFrame(b, LOCI)).collect()
    covered = lambda rows: {(c, x) for c, x1, x2 in rows for x in range(x1, x2 + 1)}
    assert covered([tuple(r) for r in got]) == covered(a) & covered(b)
    assert sum(joined) <= 400


def test_best_motif_at_sites_of_a_crowd(spark, joined):
    a, sites = made(200, 9, 60, 20, [-1.0, 1.0, 3.0]), made(100, 10, 60, 20)
    motifs = spark.createDataFrame(a, LOCI + ", score double").withColumn("strand", F.col("x1") % 2 == 0)
    got = {tuple(r)[:4] for r in MO.best_at(spark.createDataFrame(sites, LOCI), motifs).collect()}
    want = {max((m for m in a if m[3] > 0 and overlap(m, at)), key=lambda m: (m[3], -m[1], -m[2]), default=None) for at in sites}
    assert got == want - {None}
    assert sum(joined) <= 300
