"""Running totals and islands over many ranges, and overlaps of short and very long intervals, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plectra.operators import intervals as I
from plectra.operators import scans as S


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_prefixes(spark, ranges):
    rng = random.Random(3)
    rows = [(None if k % 11 == 0 else k % 3, k, rng.randint(-5, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, at long, v long").repartition(5)
    held = S.ranged(df, ["g"], ["at"])
    for kind, f in (("sum", sum), ("max", max), ("min", min)):
        for inclusive in (True, False):
            got = {r.at: r.x for r in S.prefix(held, ["g"], "x", kind, F.col("v"), inclusive).collect()}
            for g, at, _ in rows:
                before = [v for h, b, v in rows if h == g and (b < at or inclusive and b == at)]
                assert got[at] == (f(before) if before else 0 if kind == "sum" else None)
    total = {r.at: r.x for r in S.cumulative(df, [], [-F.col("at")], "x", F.col("v")).collect()}
    assert total == {at: sum(v for _, b, v in rows if b >= at) for _, at, _ in rows}
    assert S.cumulative(df.where("false"), ["g"], ["at"], "x", F.col("v")).collect() == []


def merged(rows):
    out = []
    for x1, x2 in sorted(rows):
        if out and x1 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x2)
        else:
            out.append([x1, x2])
    return {tuple(x) for x in out}


def test_islands_across_ranges(spark, ranges):
    rng = random.Random(4)
    rows = [(1, 0, 3000)] + [(1, x := rng.randint(0, 6000), x + rng.randint(0, 60)) for _ in range(150)] + [(2, 10 * k, 10 * k + 10) for k in range(60)]
    df = spark.createDataFrame(rows, "chr long, x1 long, x2 long").repartition(3)
    got = {(r.chr, r.x1, r.x2) for r in I.merge(df).collect()}
    assert got == {(c, *x) for c in (1, 2) for x in merged([r[1:] for r in rows if r[0] == c])}

    def smaller(rows):
        out = []
        for x1, x2 in sorted(set(rows)):
            if not out or x1 > out[-1][1]:
                out.append((x1, x2))
                continue
            a1, a2 = out[-1]
            out[-1] = (x1, x2) if a1 <= x1 and x2 <= a2 else (a1, a2) if x1 <= a1 and a2 <= x2 else (min(a1, x1), max(a2, x2))
        return set(out)

    got = {(r.chr, r.x1, r.x2) for r in I.merge_keep_smaller(df).collect()}
    assert got == {(c, *x) for c in (1, 2) for x in smaller([r[1:] for r in rows if r[0] == c])}


def test_overlaps_of_all_lengths(spark):
    """A quarter of a billion bases is two rows, and every pair appears once."""
    rng = random.Random(5)
    lengths = [0, 1, 500, 2047, 2048, 5000, 70_000, 3_000_000, 250_000_000]

    def made(n):
        return [(1 + k % 2, x := rng.randint(0, 4_000_000), x + rng.choice(lengths)) for k in range(n)]

    a, b = made(120), made(90)
    left, right = spark.createDataFrame(a, "chr long, x1 long, x2 long"), spark.createDataFrame(b, "chr long, y1 long, y2 long")
    got = sorted((r.chr, r.x1, r.x2, r.y1, r.y2) for r in I.overlap_join(left, right).collect())
    assert got == sorted((c, x, y, u, v) for c, x, y in a for d, u, v in b if c == d and x <= v and u <= y)
    short = left.where("x2 - x1 < 2000")
    assert I.overlap_join(short, right).count() == sum(c == d and x <= v and u <= y for c, x, y in a for d, u, v in b if y - x < 2000)
