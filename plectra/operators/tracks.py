"""One-dimensional tracks: chr, start, end, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plectra.operators import scans as S


def all_bins(chroms: DataFrame, size: int) -> DataFrame:
    """(chr, bin) of every bin that a chromosome begins."""
    return chroms.select(F.col("idx").alias("chr"), F.explode(F.expr(f"sequence(0L, (len - 1) div {size})")).alias("bin"))


def bin_mean_max(track: DataFrame, size: int) -> DataFrame:
    """(chr, bin, mean, max) of the values of rows that overlap a bin."""
    rows = track.select("chr", F.explode(F.expr(f"sequence(start div {size}, end div {size})")).alias("bin"), "value")
    return rows.groupBy("chr", "bin").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))


def tumbling(track: DataFrame, chroms: DataFrame, size: int) -> DataFrame:
    """(chr, bin, mean, max) by mid-point; windows without rows are 0."""
    rows = track.select("chr", F.expr(f"((start + end) div 2) div {size}").alias("bin"), "value")
    sums = rows.groupBy("chr", "bin").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return all_bins(chroms, size).join(sums, ["chr", "bin"], "left").select("chr", "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("max", F.lit(0.0)).alias("max"))


def coverage(vector: DataFrame, chroms: DataFrame, size: int) -> DataFrame:
    """A vector (chr, bin, value) on every bin, 0 where it has none."""
    return all_bins(chroms, size).join(vector.select("chr", "bin", "value"), ["chr", "bin"], "left").select("chr", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def crosshair(contacts: DataFrame, chroms: DataFrame, chr_idx: int, bin_: int, size: int) -> DataFrame:
    """One row of a matrix as a track, zero-filled."""
    own = contacts.where((F.col("chr1") == chr_idx) & (F.col("chr2") == chr_idx) & (F.col("bin_size") == size))
    row = own.where((F.col("bin_x") == bin_) | (F.col("bin_y") == bin_))
    row = row.select(F.when(F.col("bin_x") == bin_, F.col("bin_y")).otherwise(F.col("bin_x")).alias("bin"), F.col("counts").alias("value"))
    bins = all_bins(chroms.where(F.col("idx") == chr_idx), size)
    return bins.join(row, "bin", "left").select("chr", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def sliding_average(vector: DataFrame, radius: int) -> DataFrame:
    """Mean of a bin and `radius` rows on both sides, by chromosome."""
    w = Window.partitionBy("chr").orderBy("bin").rowsBetween(-radius, radius)
    return vector.select("chr", "bin", F.avg("value").over(w).alias("value"))


def column_sums(contacts: DataFrame) -> DataFrame:
    """(chr, bin, value, diagonal): a bin's contacts with all chromosomes, and its cell on the diagonal, of one bin size."""
    intra, inter = contacts.where("chr1 = chr2"), contacts.where("chr1 <> chr2")
    on = F.when(F.col("bin_x") == F.col("bin_y"), F.col("counts"))
    rows = intra.select(F.col("chr1").alias("chr"), F.col("bin_x").alias("bin"), "counts", on.alias("diagonal"))
    mirror = intra.where("bin_x <> bin_y").select("chr1", "bin_y", "counts", F.lit(None).cast("double"))
    others = [inter.select(f"chr{k}", b, "counts", F.lit(None).cast("double")) for k, b in ((1, "bin_x"), (2, "bin_y"))]
    return rows.union(mirror).union(others[0]).union(others[1]).groupBy("chr", "bin").agg(F.sum("counts").alias("value"), F.max("diagonal").alias("diagonal"))


def smoothed_positive(vector: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """Mean of the positive values from `radius` bins before a bin up to, and without, `radius` bins behind it.

    Values that are not positive stay as they are. A partition holds one chromosome's bins, one row each.
    """
    w = Window.partitionBy("chr").orderBy("bin").rangeBetween(-radius, radius - 1)
    mean = F.avg(F.when(F.col(value) > 0, F.col(value))).over(w)
    return vector.withColumn(value, F.when(F.col(value) > 0, mean).otherwise(F.col(value)))


def log_enrichment(vector: DataFrame, value: str = "value") -> DataFrame:
    """ln of values over the mean of all that exceed 1."""
    mean = vector.agg(F.avg(F.when(F.col(value) > 1, F.col(value))).alias("mean__"))
    return vector.crossJoin(F.broadcast(mean)).withColumn(value, F.ln(F.col(value) / F.col("mean__"))).drop("mean__")


def reverse_cumulative(vector: DataFrame) -> DataFrame:
    """Sum of a bin and all that follow, by chromosome."""
    rows = vector.select("chr", "bin", F.col("value").alias("own"))
    return S.cumulative(rows, ["chr"], [-F.col("bin")], "value", F.col("own")).drop("own")


def rank_percentile(cells: DataFrame, by: list[str], value: str = "counts") -> DataFrame:
    """100 times the fraction of a group's values strictly below; zeros stay 0."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    share = (F.rank().over(w) - 1) * 100.0 / n
    return cells.withColumn("percentile", F.when(F.col(value) == 0, F.lit(0.0)).otherwise(share))
