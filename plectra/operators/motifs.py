"""Motifs of loop anchors: unique ones by tiers of peak tracks, inferred ones by direction, and the better of two.

Loci are closed intervals (chr, x1, x2), peaks and motifs have a score, motifs also a strand (true: forward).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.operators import intervals as I
from plectra.plans.storage import stored


def loop_anchors(loops: DataFrame, least: int = 15_000) -> DataFrame:
    """(chr, x1, x2, upstream, downstream): merged anchors of at least `least` bases, and which ends of loops they hold."""
    inside = loops.where("chr1 = chr2")
    ends = [inside.select(F.col(f"chr{k}").alias("chr"), F.col(f"start{k}").alias("e1"), F.col(f"end{k}").alias("e2"), F.lit(k == 1).alias("first")) for k in (1, 2)]
    raw = stored(ends[0].union(ends[1]).distinct())
    wide = stored(I.expand_small(stored(I.merge(raw.select("chr", F.col("e1").alias("x1"), F.col("e2").alias("x2")))), least))
    return I.overlap_join(wide, raw, other=("e1", "e2")).groupBy("chr", "x1", "x2").agg(F.bool_or("first").alias("upstream"), F.bool_or(~F.col("first")).alias("downstream"))


def best_at(sites: DataFrame, motifs: DataFrame) -> DataFrame:
    """(chr, x1, x2, score, strand): the best motif of positive score at each site (ties: smaller start, then end)."""
    found = I.best_overlapping(sites, motifs.where("score > 0").select("chr", "x1", "x2", "score", "strand"))
    return found.select("chr", "x1", "x2", "score", "strand").distinct()


def unique_motifs(anchors: DataFrame, peaks: DataFrame, others: list[DataFrame], motifs: DataFrame) -> DataFrame:
    """Peaks alone at an anchor that overlap a peak of every other tier, and the best motif of each."""
    sites = stored(I.retain_unique(stored(anchors), stored(peaks)))
    for tier in others:
        sites = stored(I.keep_intersecting(sites, tier))
    return best_at(sites, motifs)


def inferred_motifs(anchors: DataFrame, peaks: DataFrame, motifs: DataFrame) -> DataFrame:
    """(chr, a1, a2, x1, x2, score, strand) of anchors of one direction with several peaks.

    Of the best motifs of these peaks an upstream anchor must overlap exactly one forward one, a downstream anchor
    exactly one reverse one. Anchors of both directions are left out.
    """
    own, peaks = stored(anchors.where("upstream <> downstream")), stored(peaks)
    parts = []
    for side, forward in (("upstream", True), ("downstream", False)):
        base = own.where(side)
        best = best_at(I.retain_multi(base, peaks), motifs).where(F.col("strand") == forward)
        at = base.select("chr", F.col("x1").alias("a1"), F.col("x2").alias("a2"))
        found = I.overlap_join(best, at, other=("a1", "a2")).groupBy("chr", "a1", "a2")
        one = found.agg(F.count("*").alias("n"), F.min(F.struct("x1", "x2", "score", "strand")).alias("m")).where("n = 1")
        parts.append(one.select("chr", "a1", "a2", "m.x1", "m.x2", "m.score", "m.strand"))
    return parts[0].union(parts[1])


def better_motif(anchors: DataFrame, motifs: DataFrame) -> DataFrame:
    """(chr, a1, a2, x1, x2, score, strand): each anchor with the motif of the higher score among those that it overlaps."""
    found = I.best_overlapping(anchors, motifs.select("chr", "x1", "x2", "score", "strand"))
    return found.withColumnsRenamed({"b1": "a1", "b2": "a2"})
