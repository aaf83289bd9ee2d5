"""Expected counts by distance from the diagonal."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div

#: Counts that a smoothing window gathers before it is narrowed again.
ENOUGH = 400.0


def actual_distance(contacts: DataFrame) -> DataFrame:
    """(bin_size, dist, actual): counts by distance, over all chromosomes; NaN skipped."""
    intra = contacts.where("chr1 = chr2").where(~F.isnan("counts"))
    return intra.groupBy("bin_size", (F.col("bin_y") - F.col("bin_x")).alias("dist")).agg(F.sum("counts").alias("actual"))


def chromosome_totals(contacts: DataFrame) -> DataFrame:
    """(bin_size, chr, observed) of cells inside a chromosome."""
    return contacts.where("chr1 = chr2").where(~F.isnan("counts")).groupBy("bin_size", F.col("chr1").alias("chr")).agg(F.sum("counts").alias("observed"))


def possible_distance(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """(bin_size, dist, possible): bin pairs at a distance, over chromosomes with data; bins = length div bin size."""
    used = chromosome_totals(contacts).select("bin_size", "chr")
    sizes = used.join(F.broadcast(chroms.select(F.col("idx").alias("chr"), "len")), "chr").select("bin_size", F.expr("len div bin_size").alias("n"))
    each = sizes.where("n > 0").select("bin_size", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("dist"))
    return each.groupBy("bin_size", "dist").agg(F.sum(F.col("n") - F.col("dist")).alias("possible"))


def raw_expected(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """(bin_size, dist, value): actual over possible, unsmoothed; distances without counts are 0."""
    joined = possible_distance(contacts, chroms).join(actual_distance(contacts), ["bin_size", "dist"], "left")
    return joined.select("bin_size", "dist", ieee_div(F.coalesce("actual", F.lit(0.0)), "possible").alias("value"))


def smoothed(actual: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Density by distance, each over a window of distances with ENOUGH counts; all sums are differences of running totals.

    A window with too few counts ends where it first has enough, or behind the last distance. One with
    enough loses as many distances at both ends as leave it enough. The next distance's window ends two further.
    """
    n = len(actual)
    counts, pairs = (np.r_[0.0, np.cumsum(np.r_[x, 0.0])] for x in (actual, possible))
    enough_at = np.minimum(np.searchsorted(counts, counts + ENOUGH) - 1, n)
    first, last = 0, 0
    ends = np.empty((n, 2), np.int64)
    for i in range(n):
        if counts[last + 1] - counts[first] < ENOUGH:
            last = max(last, int(enough_at[first]))
        else:
            scant = bisect_left(range(1, (last - first) // 2 + 1), True, key=lambda k: counts[last + 1 - k] - counts[first + k] < ENOUGH)
            first, last = first + scant, last - scant
        ends[i] = first, last
        last = max(last, min(last + 2, n - 1))
    total, places = (x[ends[:, 1] + 1] - x[ends[:, 0]] for x in (counts, pairs))
    return np.divide(total, places, out=np.full(n, np.nan), where=places != 0)


def smooth_expected(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """(bin_size, dist, value): smoothed density; one group a bin size, as long as a chromosome has bins."""
    joined = possible_distance(contacts, chroms).join(actual_distance(contacts), ["bin_size", "dist"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dist")
        value = smoothed(rows["actual"].fillna(0.0).to_numpy(float), rows["possible"].to_numpy(float))
        return pd.DataFrame({"bin_size": rows["bin_size"], "dist": rows["dist"], "value": value})

    return joined.groupBy("bin_size").applyInPandas(run, "bin_size long, dist long, value double")


def scale_factors(expected: DataFrame, contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """(bin_size, chr, factor): expected total of a chromosome over its observed total."""
    totals = chromosome_totals(contacts).join(F.broadcast(chroms.select(F.col("idx").alias("chr"), "len")), "chr")
    totals = totals.withColumn("n", F.expr("len div bin_size"))
    each = totals.join(expected, "bin_size").where("dist < n")
    sums = each.groupBy("bin_size", "chr").agg(F.sum((F.col("n") - F.col("dist")) * F.col("value")).alias("e"), F.first("observed").alias("observed"))
    return sums.select("bin_size", "chr", ieee_div("e", "observed").alias("factor"))


def with_expected(contacts: DataFrame, expected: DataFrame, averages: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Adds `expected`: inside a chromosome by distance (the last value beyond the end) over its factor, else the
    matrix' average, or 1 if that is not positive. The joined tables are as long as one chromosome has bins."""
    last = expected.groupBy("bin_size").agg(F.max("dist").alias("last__"))
    out = contacts.join(F.broadcast(last), "bin_size", "left")
    out = out.withColumn("dist__", F.least(F.abs(F.col("bin_y") - F.col("bin_x")), F.col("last__")))
    values = expected.select("bin_size", F.col("dist").alias("dist__"), F.col("value").alias("value__"))
    out = out.join(values, ["bin_size", "dist__"], "left")
    out = out.join(F.broadcast(averages), ["chr1", "chr2", "bin_size"], "left")
    if scale is None:
        factor = F.lit(1.0)
    else:
        out = out.join(F.broadcast(scale.select("bin_size", F.col("chr").alias("chr1"), "factor")), ["bin_size", "chr1"], "left")
        factor = F.coalesce("factor", F.lit(1.0))
    between = F.when(F.col("average_count") > 0, F.col("average_count")).otherwise(F.lit(1.0))
    out = out.withColumn("expected", F.when(F.col("chr1") == F.col("chr2"), ieee_div("value__", factor)).otherwise(between))
    return out.drop("last__", "dist__", "value__", "factor")


def merge_expected(functions: list[DataFrame]) -> DataFrame:
    """Element-wise sum of functions (bin_size, dist, value) up to the shortest one's end, without factors."""
    parts = [f.select("bin_size", "dist", "value", F.lit(i).alias("f")) for i, f in enumerate(functions)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ends = every.groupBy("bin_size", "f").agg(F.max("dist").alias("last")).groupBy("bin_size").agg(F.min("last").alias("last"))
    return every.join(F.broadcast(ends), "bin_size").where("dist <= last").groupBy("bin_size", "dist").agg(F.sum("value").alias("value"))
