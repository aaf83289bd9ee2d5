"""Coordinates: fragments of positions, scaffolds, custom chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plectra.operators import scans as S

#: Bases of a bucket of restriction sites.
BUCKET = 10_000


def _buckets(sites: DataFrame, width: int) -> DataFrame:
    """(chr, b__, base__, before__, after__, own__): sites of each bucket, how many lie before, and the nearest around.

    Every bucket up to a chromosome's last site is there, so that an as-of lookup is one equi-join.
    """
    own = sites.groupBy("chr", F.expr(f"pos div {width}").alias("b__")).agg(F.sort_array(F.collect_list("pos")).alias("own__"))
    spans = sites.groupBy("chr").agg(F.expr(f"max(pos) div {width}").alias("top__"))
    every = spans.select("chr", F.explode(F.expr("sequence(0L, top__)")).alias("b__")).join(own, ["chr", "b__"], "left")
    up = Window.partitionBy("chr").orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("chr").orderBy("b__").rowsBetween(1, Window.unboundedFollowing)
    return every.withColumns(
        {
            "base__": F.coalesce(F.sum(F.size("own__")).over(up), F.lit(0)),
            "before__": F.max(F.array_max("own__")).over(up),
            "after__": F.min(F.array_min("own__")).over(down),
            "own__": F.coalesce("own__", F.array().cast("array<bigint>")),
        }
    ).withColumn("base__", F.greatest("base__", F.lit(0)))


def _looked_up(df: DataFrame, sites: DataFrame, chr_col: str, pos_col: str, width: int) -> DataFrame:
    sites = sites.where("pos is not null")
    tops = sites.groupBy("chr").agg(F.expr(f"max(pos) div {width}").alias("top__")).withColumnRenamed("chr", chr_col)
    own = _buckets(sites, width).withColumnRenamed("chr", chr_col)
    placed = df.join(F.broadcast(tops), chr_col, "left").withColumn("b__", F.least(F.expr(f"{pos_col} div {width}"), "top__"))
    return placed.join(own, [chr_col, "b__"], "left")


def fragments(df: DataFrame, sites: DataFrame, chr_col: str, pos_col: str, out: str = "frag", width: int = BUCKET) -> DataFrame:
    """Adds the number of the fragment that holds a position: how many sites lie at or before it."""
    at = _looked_up(df, sites, chr_col, pos_col, width)
    inside = F.size(F.filter("own__", lambda s: s <= F.col(pos_col)))
    value = F.coalesce(F.col("base__") + inside, F.lit(0)).cast("long")
    return at.withColumn(out, value).drop("b__", "top__", "own__", "base__", "before__", "after__")


def site_distance(df: DataFrame, sites: DataFrame, chr_col: str, pos_col: str, out: str = "site_distance", width: int = BUCKET) -> DataFrame:
    """Adds the distance to the nearest site on either side."""
    at = _looked_up(df, sites, chr_col, pos_col, width)
    p = F.col(pos_col)
    near = F.least(F.array_min(F.transform("own__", lambda s: F.abs(s - p))), p - F.col("before__"), F.abs(F.col("after__") - p))
    return at.withColumn(out, near).drop("b__", "top__", "own__", "base__", "before__", "after__")


def fragments_to_bed(sites: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chr, start, end, frag): fragments as half-open intervals, the last one up to the chromosome's end."""
    order = Window.partitionBy("chr").orderBy("site_idx")
    upper = sites.select("chr", F.coalesce(F.lag("pos").over(order), F.lit(0)).alias("start"), F.col("pos").alias("end"), F.col("site_idx").alias("frag"))
    last = sites.groupBy("chr").agg(F.max("pos").alias("start"), (F.max("site_idx") + 1).alias("frag"))
    last = last.join(F.broadcast(chroms.select(F.col("idx").alias("chr"), F.col("len").alias("end"))), "chr").select("chr", "start", "end", "frag")
    return upper.unionByName(last)


def annotate_fragments(loci: DataFrame, sites: DataFrame) -> DataFrame:
    """Intervals with their first and last fragment."""
    return fragments(fragments(loci, sites, "chr", "x1", "first_frag"), sites, "chr", "x2", "last_frag")


def place_scaffolds(order: DataFrame) -> DataFrame:
    """order(ord, signed_id, length, was_inverted) -> current start (1-based running sum) and orientation."""
    placed = S.cumulative(order, [], ["ord"], "before__", F.col("length"), inclusive=False)
    flipped = (F.col("signed_id") < 0) != F.col("was_inverted")
    return placed.select("ord", F.abs("signed_id").alias("id"), "length", (F.col("before__") + 1).alias("cur_start"), flipped.alias("inverted"))


def _lift_axis(cells: DataFrame, scaffolds: DataFrame, bin_size: int, axis: str) -> DataFrame:
    """Bins of one axis moved with their scaffold; scaffolds are exploded into the bins they start in, an equi-join."""
    s = scaffolds.select("orig_start", "length", "cur_start", "inverted")
    first, last = F.expr(f"(orig_start - 1 + {bin_size} - 1) div {bin_size}"), F.expr(f"(orig_start + length - 2) div {bin_size}")
    own = s.withColumn(axis, F.explode(F.sequence(first, last)))
    out = cells.join(own, axis, "left")
    p = F.col(axis) * bin_size + 1
    forward = F.col("cur_start") + (p - F.col("orig_start"))
    backward = (F.col("cur_start") + F.col("length") - 1) - p + 2 - bin_size + F.col("orig_start") - 1
    moved = F.floor((F.when(F.col("inverted"), backward).otherwise(forward) - 1) / bin_size)
    return out.withColumn(f"{axis}__", F.coalesce(moved, F.col(axis)).cast("long")).drop("orig_start", "length", "cur_start", "inverted")


def lift_contacts(cells: DataFrame, scaffolds: DataFrame, bin_size: int) -> DataFrame:
    """Cells of one chromosome's matrix in a new scaffold order: both axes moved, the triangle kept, cells summed.

    A bin belongs to the scaffold that holds its first base; bins of no scaffold stay where they are.
    """
    both = _lift_axis(_lift_axis(cells, scaffolds, bin_size, "bin_x"), scaffolds, bin_size, "bin_y")
    keyed = both.select("chr1", "chr2", "bin_size", F.least("bin_x__", "bin_y__").alias("bin_x"), F.greatest("bin_x__", "bin_y__").alias("bin_y"), "counts")
    return keyed.groupBy("chr1", "chr2", "bin_size", "bin_x", "bin_y").agg(F.sum("counts").alias("counts"))


def custom_chromosome(regions: DataFrame, gap: int = 0) -> DataFrame:
    """Disjoint regions (chr, x1, x2) laid end to end: adds their start in the new chromosome."""
    size = F.col("x2") - F.col("x1") + gap
    return S.cumulative(regions.select("chr", "x1", "x2"), [], ["chr", "x1"], "new_start", size, inclusive=False)


def lift_track(track: DataFrame, placed: DataFrame) -> DataFrame:
    """Track rows (chr, start, end, value) cut to the regions of a custom chromosome and moved there."""
    from plectra.operators.intervals import overlap_join

    a = track.select("chr", F.col("start").alias("x1"), F.col("end").alias("x2"), "value")
    b = placed.select("chr", F.col("x1").alias("r1"), F.col("x2").alias("r2"), "new_start")
    hit = overlap_join(a, b, ("x1", "x2"), ("r1", "r2"))
    shift = F.col("new_start") - F.col("r1")
    return hit.select((F.greatest("x1", "r1") + shift).alias("start"), (F.least("x2", "r2") + shift).alias("end"), "value")
