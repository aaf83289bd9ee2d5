"""Projections and filters on read pairs: chr1, chr2, pos1, pos2, mapq1, mapq2, strand1, strand2, score, ..."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quality taken for a pair without one.
NO_MAPQ = 1000
ENDS = ("chr", "pos", "frag", "mapq", "strand", "seq")


def known_contigs(pairs: DataFrame, chroms: DataFrame) -> DataFrame:
    """Pairs whose two chromosomes are both known. The chromosome table is a dimension of some dozen rows."""
    out = pairs
    for end in ("chr1", "chr2"):
        out = out.join(F.broadcast(chroms.select(F.col("idx").alias(end))), end, "left_semi")
    return out


def intra_only(pairs: DataFrame) -> DataFrame:
    return pairs.where("chr1 = chr2")


def in_chromosomes(pairs: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """Both ends in the set."""
    wanted = list(wanted)
    return pairs.where(F.col("chr1").isin(wanted) & F.col("chr2").isin(wanted))


def orientation():
    """inner, outer, left or right, by strand of the end with the smaller position."""
    first_forward = F.when(F.col("pos1") < F.col("pos2"), F.col("strand1")).otherwise(F.col("strand2"))
    return (
        F.when(F.col("strand1") == F.col("strand2"), F.when(F.col("strand1"), "right").otherwise("left"))
        .when(first_forward, "inner")
        .otherwise("outer")
    )


def with_alignment(pairs: DataFrame, kind: str) -> DataFrame:
    """kind: inner, outer, left, right or tandem (left or right); asked of pairs between chromosomes, too."""
    wanted = ["left", "right"] if kind == "tandem" else [kind]
    return pairs.where(orientation().isin(wanted))


def min_mapq(pairs: DataFrame, least: int) -> DataFrame:
    a, b = (F.coalesce(F.col(c), F.lit(NO_MAPQ)) for c in ("mapq1", "mapq2"))
    return pairs.where(F.least(a, b) >= least)


def across_fragments(pairs: DataFrame) -> DataFrame:
    """Drops pairs inside one restriction fragment."""
    return pairs.where("not (chr1 = chr2 and frag1 = frag2)")


def subsample(pairs: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Keeps a share of the pairs, chosen by a hash of `keys`, so that a repeated run keeps the same ones."""
    return pairs.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(share * 1_000_000))


def flipped(pairs: DataFrame) -> DataFrame:
    """Ends swapped where needed, so that chr1 <= chr2; columns of both ends go along."""
    swap = F.col("chr1") > F.col("chr2")
    names = [c for c in ENDS if f"{c}1" in pairs.columns and f"{c}2" in pairs.columns]
    new = {}
    for c in names:
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        new[f"{c}1"], new[f"{c}2"] = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return pairs.withColumns(new)


def clamped(pairs: DataFrame, chroms: DataFrame) -> DataFrame:
    """Positions held inside [0, chromosome length]."""
    out = pairs
    for i in (1, 2):
        sizes = F.broadcast(chroms.select(F.col("idx").alias(f"chr{i}"), F.col("len").alias("len__")))
        inside = F.least(F.greatest(F.col(f"pos{i}"), F.lit(0)), F.col("len__"))
        out = out.join(sizes, f"chr{i}").withColumn(f"pos{i}", inside).drop("len__")
    return out


def randomized(pairs: DataFrame, sites: DataFrame, seed: int = 5) -> DataFrame:
    """Each end moved to a place inside its fragment that follows from a hash of the end and the seed.

    Fragment k spans [site k, site k+1); the first starts at 0. Needs frag1 and frag2.
    """
    order = Window.partitionBy("chr").orderBy("site_idx")
    spans = sites.select("chr", F.col("site_idx").alias("frag"), F.col("pos").alias("hi"), F.coalesce(F.lag("pos").over(order), F.lit(0)).alias("lo"))
    out = pairs
    for i in (1, 2):
        own = F.broadcast(spans.select(F.col("chr").alias(f"chr{i}"), F.col("frag").alias(f"frag{i}"), F.col("lo").alias("lo__"), F.col("hi").alias("hi__")))
        place = F.col("lo__") + F.pmod(F.xxhash64(f"chr{i}", f"pos{i}", F.lit(seed + i)), F.col("hi__") - F.col("lo__"))
        out = out.join(own, [f"chr{i}", f"frag{i}"], "left").withColumn(f"pos{i}", F.coalesce(place, f"pos{i}")).drop("lo__", "hi__")
    return out


def genome_offsets(chroms: DataFrame) -> DataFrame:
    """(idx, offset): lengths of all chromosomes before, in index order."""
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chroms.select("idx", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("offset"))


def whole_genome(pairs: DataFrame, chroms: DataFrame) -> DataFrame:
    """Both ends on the one pseudo-chromosome 0, in units of 1000 bases."""
    offsets = genome_offsets(chroms)
    out = pairs
    for i in (1, 2):
        own = F.broadcast(offsets.select(F.col("idx").alias(f"chr{i}"), F.col("offset").alias("o__")))
        out = out.join(own, f"chr{i}").withColumn(f"pos{i}", F.expr(f"(o__ + pos{i}) div 1000")).drop("o__")
    return out.withColumns({"chr1": F.lit(0).cast("long"), "chr2": F.lit(0).cast("long")})


def filter_pairs(pairs: DataFrame, mapq: int = 0, chroms=None, diagonal: bool = False, alignment: str | None = None, skip_intra_frag: bool = False) -> DataFrame:
    """The build's filters in one pass; all of them are narrow and reach the scan together."""
    out = intra_only(pairs) if diagonal else pairs
    if chroms is not None:
        out = in_chromosomes(out, chroms)
    if alignment:
        out = with_alignment(out, alignment)
    if mapq:
        out = min_mapq(out, mapq)
    return across_fragments(out) if skip_intra_frag else out
