"""Counts of repeated loops, whole maps, and plans that read and hold no more than they must."""

import numpy as np
import pytest

from plectra.operators import loop_merge, triples
from plectra.plans import fixtures as fx
from plectra.plans import q_maps, registry

COORDS = "chr1 long, start1 long, end1 long, chr2 long, start2 long, end2 long, observed double"


@pytest.mark.parametrize("second", [False, True])
def test_a_repeated_loop_has_its_smallest_count(spark, second):
    fine, coarse = (1000, 2000) if second else (5000, 10_000)
    loop = (1, 10_000, 10_000 + fine, 1, 900_000, 900_000 + fine)
    far = (2, 0, coarse, 2, 500_000, 500_000 + coarse)
    lists = {fine: spark.createDataFrame([(*loop, 500.0), (*loop, 3.0)], COORDS).coalesce(1), coarse: spark.createDataFrame([(*far, 1.0)], COORDS)}
    got = loop_merge.merge_resolutions(lists, second).collect()
    assert [(r.chr1, r.start1, r.bin_size) for r in got] == [(2, 0, coarse)]


def test_the_expectation_is_of_all_cells(spark, sf_dir):
    got = registry.QUERIES["q_expected"](spark, sf_dir)
    keys = q_maps.KEYS.split(", ")
    assert {r.bin_size for r in got.select("bin_size").distinct().collect()} == set(fx.SIZES)
    assert q_maps.contacts(spark, sf_dir).select(keys).exceptAll(got.select(keys)).count() == 0


def test_pair_files_follow_the_partitions(spark, sf_dir):
    got = registry.QUERIES["src_pairs_dcic"](spark, sf_dir)
    parts = fx.pairs(spark, sf_dir).rdd.getNumPartitions()
    assert {f.rsplit("/", 1)[-1] for f in got.inputFiles()} == {"head.pairs"} | {f"p{k}.pairs" for k in range(parts)}
    assert got.count() == fx.pairs(spark, sf_dir).count()


@pytest.mark.parametrize("parts", [1, 7])
def test_crowded_triples_are_no_group_of_a_chromosome(spark, parts):
    rng = np.random.default_rng(parts)
    points = sorted({tuple(int(v) for v in p) for p in rng.integers(0, [400, 60, 60], (900, 3))})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(c, *p) for p in points for c in (1, 2)], "chr long, x1 long, x2 long, x3 long")
    found = triples.without_duplicates(df.union(df))
    got = sorted(tuple(r) for r in found.collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, centre, seen = [], None, None
    for p in points:
        if centre and all(abs(a - b) < 20 for a, b in zip(p, centre, strict=True)):
            seen = [s | {v} for s, v in zip(seen, p, strict=True)]
            centre = tuple(sum(s) // len(s) for s in seen)
        else:
            want += [centre] if centre else []
            centre, seen = p, [{v} for v in p]
    assert got == sorted((c, *p) for p in [*want, centre] for c in (1, 2))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_cells_of_all_sizes_read_the_pairs_once(spark, sf_dir):
    plan = q_maps.contacts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
