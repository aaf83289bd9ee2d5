"""Three-way contacts inside a chromosome: (chr, x1, x2, x3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.operators import scans as S


def without_duplicates(triples: DataFrame, tolerance: int = 20) -> DataFrame:
    """Runs of triples, in order of all three positions, fused into their centroids; triples without a position are left out.

    A triple joins the run before it if each position is less than `tolerance` from the run's centroid, the
    integer mean of the distinct positions so far. An equal triple changes nothing. The last triple of a run is less than
    `tolerance` from the centroid, so a run surely ends where a position of neighbours differs by twice that. Ranges of the
    order are tasks, from the first such place in each on to the first in a later one; they stream, and hold one run at a time.
    """
    whole = triples.select("chr", "x1", "x2", "x3").where("x1 is not null and x2 is not null and x3 is not null")
    rows = S.ranged(whole.distinct(), ["chr"], ["x1", "x2", "x3"])
    # In this order the largest triple before a triple is the one next to it.
    rows = S.prefix(rows, ["chr"], "last__", "max", F.struct("x1", "x2", "x3"), False)
    apart = F.col("last__").isNull()
    for x in ("x1", "x2", "x3"):
        apart |= F.abs(F.col(x) - F.col(f"last__.{x}")) >= 2 * tolerance
    owned = S.prefix(rows, ["chr"], "owner__", "max", F.when(apart, F.col("part__")), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(4)], names=["chr", "x1", "x2", "x3"])

        seen: list[set[int]] = []
        centre: tuple[int, ...] = ()
        block: tuple = ()
        for batch in batches:
            out: list[tuple] = []
            owner, chrom, *point = (c.to_pylist() for c in batch.columns)
            for here, at in zip(zip(owner, chrom, strict=True), zip(*point, strict=True), strict=True):
                if here == block and all(abs(p - c) < tolerance for p, c in zip(at, centre, strict=True)):
                    for values, p in zip(seen, at, strict=True):
                        values.add(p)
                    centre = tuple(sum(v) // len(v) for v in seen)
                    continue
                if block:
                    out.append((block[1], *centre))
                block, centre, seen = here, at, [{p} for p in at]
            yield found(out)
        if block:
            yield found([(block[1], *centre)])

    dealt = owned.select("owner__", "chr", "x1", "x2", "x3", "at__").repartition("owner__").sortWithinPartitions("owner__", "at__").drop("at__")
    return dealt.mapInArrow(run, "chr long, x1 long, x2 long, x3 long")


def dense_cubes(triples: DataFrame, size: int = 300_000, apart: int = 10) -> DataFrame:
    """(chr, c1, c2, c3, n): cubes with all three bins over `apart` from each other and more triples than
    both two thirds of the chromosome's fullest cube and twice its emptiest."""
    bins = triples.select("chr", *(F.expr(f"x{k} div {size}").alias(f"c{k}") for k in (1, 2, 3)))
    far = [F.abs(F.col(a) - F.col(b)) > apart for a, b in (("c1", "c2"), ("c2", "c3"), ("c1", "c3"))]
    cubes = bins.where(far[0] & far[1] & far[2]).groupBy("chr", "c1", "c2", "c3").agg(F.count("*").alias("n"))
    limits = cubes.groupBy("chr").agg(F.greatest(F.expr("2 * max(n) div 3"), 2 * F.min("n")).alias("limit"))
    return cubes.join(limits, "chr").where("n > limit").select("chr", "c1", "c2", "c3", "n")
