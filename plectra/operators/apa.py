"""Aggregate peak analysis: windows of contacts around features, stacked."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div


def windows(contacts: DataFrame, features: DataFrame, bin_size: int, half: int) -> DataFrame:
    """(feature, i, j, counts): cells within `half` bins of each feature's middle, stored triangle only.

    A feature is exploded into the rows of its window, so the join is by chromosomes and row, with the column as
    a residual range; duplicates of a rectangle count once.
    """
    mids = features.select("chr1", "chr2", F.expr(f"((start1 + end1) div 2) div {bin_size}").alias("m1"), F.expr(f"((start2 + end2) div 2) div {bin_size}").alias("m2")).distinct()
    rows = mids.withColumn("bin_x", F.explode(F.expr(f"sequence(m1 - {half}, m1 + {half})")))
    cells = contacts.where(F.col("bin_size") == bin_size).select("chr1", "chr2", "bin_x", "bin_y", "counts")
    hit = cells.join(rows, ["chr1", "chr2", "bin_x"]).where(F.abs(F.col("bin_y") - F.col("m2")) <= half)
    return hit.select("chr1", "chr2", "m1", "m2", (F.col("bin_x") - F.col("m1") + half).alias("i"), (F.col("bin_y") - F.col("m2") + half).alias("j"), "counts")


def stack(found: DataFrame, half: int) -> DataFrame:
    """(i, j, raw, mean_normed, centre_normed, ranked) summed over features, every place of the window.

    ranked: 100 times the share of the window's places with a smaller count; empty places stay 0.
    """
    n = float((2 * half + 1) ** 2)
    own = ["chr1", "chr2", "m1", "m2"]
    stored, positive = Window.partitionBy(*own), F.col("counts") > 0
    below = n - F.count_if(positive).over(stored) + F.rank().over(stored.orderBy("counts")) - 1 - F.count_if(~positive).over(stored)
    found = found.withColumn("rank__", F.when(positive, below * 100.0 / n).otherwise(0.0))
    per = found.groupBy("chr1", "chr2", "m1", "m2").agg(
        F.greatest(F.lit(1.0), F.sum("counts") / n).alias("mean"),
        F.max(F.when((F.col("i") == half) & (F.col("j") == half), F.col("counts"))).alias("centre"),
        F.min(F.when(F.col("counts") > 0, F.col("counts"))).alias("least"),
    )
    scaled = found.join(per, ["chr1", "chr2", "m1", "m2"])
    centre = F.coalesce(F.when(F.col("centre") > 0, F.col("centre")), F.col("least"), F.lit(1.0))
    sums = scaled.groupBy("i", "j").agg(
        F.sum("counts").alias("raw"), F.sum(F.col("counts") / F.col("mean")).alias("mean_normed"), F.sum(F.col("counts") / centre).alias("centre_normed"),
        F.sum("rank__").alias("ranked"),
    )
    spark = found.sparkSession
    places = spark.range((2 * half + 1) ** 2).select(F.expr(f"id div {2 * half + 1}").alias("i"), (F.col("id") % (2 * half + 1)).alias("j"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("raw", "mean_normed", "centre_normed", "ranked")}
    return places.join(F.broadcast(sums), ["i", "j"], "left").select("i", "j", *(v.alias(c) for c, v in zero.items()))


def region_statistics(stacked: DataFrame, half: int, corner: int, value: str = "raw") -> DataFrame:
    """Peak to mean, to the four corners, and the Z-score of the lower left corner, of one stacked window."""
    last = 2 * half + 1 - corner
    v, i, j = F.col(value), F.col("i"), F.col("j")
    centre = F.max(F.when((i == half) & (j == half), v))
    boxes = {"ul": (i < corner) & (j < corner), "ur": (i < corner) & (j >= last), "ll": (i >= last) & (j < corner), "lr": (i >= last) & (j >= last)}
    n = (2 * half + 1) ** 2
    row = stacked.agg(
        centre.alias("centre"), ((F.sum(v) - centre) / (n - 1)).alias("rest"), *(F.avg(F.when(b, v)).alias(k) for k, b in boxes.items()), F.stddev_samp(F.when(boxes["ll"], v)).alias("sd")
    )
    return row.select(
        ieee_div("centre", "rest").alias("p2m"), *(ieee_div("centre", k).alias(f"p2{k}") for k in boxes), ieee_div(F.col("centre") - F.col("ll"), "sd").alias("z_ll")
    )


def by_distance(contacts: DataFrame, features: DataFrame, bin_size: int, half: int, corner: int, buckets: int = 8) -> DataFrame:
    """(bucket, features, p2ll) over doubling distances of mid-points, in bins."""
    found = windows(contacts, features, bin_size, half)
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.abs(F.col("m2") - F.col("m1")), F.lit(1))))))
    last = 2 * half + 1 - corner
    sums = found.withColumn("bucket", bucket.cast("long")).groupBy("bucket").agg(
        F.count_distinct("chr1", "chr2", "m1", "m2").alias("features"),
        F.sum(F.when((F.col("i") == half) & (F.col("j") == half), F.col("counts")).otherwise(0.0)).alias("centre"),
        (F.sum(F.when((F.col("i") >= last) & (F.col("j") < corner), F.col("counts")).otherwise(0.0)) / corner**2).alias("ll"),
    )
    return sums.select("bucket", "features", ieee_div("centre", "ll").alias("p2ll"))


def enhancements(found: DataFrame, half: int) -> DataFrame:
    """(chr1, chr2, m1, m2, enhancement): each window's centre over the mean of its other places."""
    centre = F.sum(F.when((F.col("i") == half) & (F.col("j") == half), F.col("counts")).otherwise(0.0))
    sums = found.groupBy("chr1", "chr2", "m1", "m2").agg(centre.alias("c"), F.sum("counts").alias("t"))
    rest = (F.col("t") - F.col("c")) / float((2 * half + 1) ** 2 - 1)
    return sums.select("chr1", "chr2", "m1", "m2", ieee_div(F.col("c"), rest).alias("enhancement"))


def enlarged(found: DataFrame, size: int, folds: int) -> DataFrame:
    """Windows of size x size places, each place made folds x folds, by linear interpolation between places.

    Place k lies at k * folds; behind the last one its value is repeated. Each cell is spread to the places
    that it weighs in, so the work is a sum by place, and empty places cost nothing.
    """
    spread = found
    for axis in ("i", "j"):
        reach = f"sequence(greatest(0L, ({axis} - 1) * {folds} + 1), least({size * folds - 1}L, ({axis} + 1) * {folds} - 1))"
        spread = spread.withColumn(f"{axis}__", F.explode(F.expr(reach)))
        far = F.abs(F.col(f"{axis}__") - F.col(axis) * folds) / float(folds)
        behind = (F.col(axis) == size - 1) & (F.col(f"{axis}__") > F.col(axis) * folds)
        spread = spread.withColumn("counts", F.col("counts") * F.when(behind, 1.0).otherwise(1.0 - far))
    sums = spread.groupBy("chr1", "chr2", "m1", "m2", "i__", "j__").agg(F.sum("counts").alias("counts"))
    return sums.withColumnsRenamed({"i__": "i", "j__": "j"})


def reduced(found: DataFrame, box: int) -> DataFrame:
    """The largest count of each box x box places (0 or more, as places without a cell are 0)."""
    at = [F.expr(f"{axis} div {box}").alias(axis) for axis in ("i", "j")]
    return found.groupBy("chr1", "chr2", "m1", "m2", *at).agg(F.greatest(F.lit(0.0), F.max("counts")).alias("counts"))


def resized(found: DataFrame, size: int, target: int) -> DataFrame:
    """Windows of size x size places as target x target: enlarged to the least common multiple, then reduced."""
    both = math.lcm(size, target)
    return reduced(enlarged(found, size, both // size), both // target)
