"""Operators with a dense or sequential kernel: loops; and the difference of compartments.

Each runs the kernel once a chromosome, tile or window, inside a grouped pandas function; groups are bounded by tile sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectra.kernels import peaks as K
from plectra.operators.binning import mirrored
from plectra.operators.intervals import islands
from plectra.plans.storage import discard, stored

#: Rows of expectations of the second generation of loop calls, and those for expectations under one.
ROWS, ROWS_BELOW = 50, 11
#: Bin size, false discovery rate in per cent, peak width, window width, cluster radius; first generation of loop calls.
FIRST_LOOPS = [(5000, 10, 4, 7, 20000), (10000, 10, 2, 5, 20000), (25000, 10, 1, 3, 50000)]
#: The same of the second generation.
SECOND_LOOPS = [(1000, 10, 5, 10, 3000), (2000, 10, 4, 10, 6000), (5000, 10, 4, 7, 10000), (10000, 10, 2, 5, 20000)]


def loop_settings(spark: SparkSession, second: bool = False) -> DataFrame:
    """(bin_size, fdr, peak, window, radius): what loops of each bin size are called with."""
    return spark.createDataFrame(SECOND_LOOPS if second else FIRST_LOOPS, "bin_size long, fdr long, peak long, window long, radius long")


def compartment_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chr, bin, same, different): difference of two eigenvectors after b's sign follows the majority of a's."""
    keys = ["bin_size", "chr", "bin"]
    both = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys)
    votes = both.groupBy("bin_size", "chr").agg(F.when(F.sum(F.signum("a") * F.signum("b")) < 0, -1.0).otherwise(1.0).alias("sign"))
    aligned = both.join(F.broadcast(votes), ["bin_size", "chr"]).withColumn("b", F.col("b") * F.col("sign"))
    change = F.abs(F.col("a") - F.col("b")) * F.signum("a")
    same = F.signum("a") == F.signum("b")
    return aligned.select(*keys, F.when(same, change).otherwise(0.0).alias("same"), F.when(~same, change).otherwise(0.0).alias("different"))


def tiles(cells: DataFrame, size: int, margin: int = K.MARGIN) -> DataFrame:
    """Cells by the tiles (ti, tj) of `size` bins whose area, widened by the margin, holds them; both triangles."""
    both = mirrored(cells.where("chr1 = chr2"))
    span = "sequence(({0} - {m}) div {s}, ({0} + {m}) div {s})"
    ti = F.explode(F.expr(f"filter({span.format('i', m=margin, s=size)}, t -> t >= 0)"))
    tj = F.explode(F.expr(f"filter({span.format('j', m=margin, s=size)}, t -> t >= 0)"))
    return both.withColumn("ti", ti).withColumn("tj", tj).where("ti <= tj")


def loop_kernel(cells: DataFrame, expected: DataFrame, vectors: DataFrame | None = None, window: int = 5, peak: int = 2, tile: int = 500) -> DataFrame:
    """(chr, i, j, observed, bl, donut, h, v) of cells above the diagonal, from normalised counts of one bin size.

    expected: (dist, value) of that size; vectors: (chr, bin, value), ones where there are none. Both are as long
    as one chromosome and go with the function.
    """
    dist = expected.orderBy("dist").toPandas()
    by_distance = dist["value"].to_numpy(float)
    held = {} if vectors is None else {c: g.set_index("bin")["value"] for c, g in vectors.toPandas().groupby("chr")}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chr_, ti, tj = int(rows["chr1"].iloc[0]), int(rows["ti"].iloc[0]), int(rows["tj"].iloc[0])
        r0, c0 = max(0, ti * tile - K.MARGIN), max(0, tj * tile - K.MARGIN)
        nr, nc = (ti + 1) * tile + K.MARGIN - r0, (tj + 1) * tile + K.MARGIN - c0
        m = np.zeros((nr, nc))
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        m[i - r0, j - c0] = rows["counts"].to_numpy()
        v = np.ones(max(r0 + nr, c0 + nc))
        if chr_ in held:
            s = held[chr_]
            inside = s.index < len(v)
            v[s.index[inside]] = s[inside]
        own = (i // tile == ti) & (j // tile == tj) & (j > i)
        i, j = i[own], j[own]
        found = K.enrichment(m, by_distance, v, i, j, window, peak, r0, c0)
        return pd.DataFrame({"chr": chr_, "i": i, "j": j, **found})

    schema = "chr long, i long, j long, observed double, bl double, donut double, h double, v double"
    return tiles(cells, tile).groupBy("chr1", "ti", "tj").applyInPandas(run, schema)


def loop_histogram(kernel: DataFrame) -> DataFrame:
    """(mask, bin, observed, n) over the four expectations' logarithmic bins."""
    stacked = kernel.select("observed", F.explode(F.create_map(*(x for m in K.MASKS for x in (F.lit(m), F.col(m))))).alias("mask", "e"))
    valid = stacked.where(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") != float("inf")) & ~F.isnan("observed"))
    bin_ = F.least(F.lit(K.LAMBDAS - 1), F.greatest(F.lit(0), F.floor(F.ln(F.when(F.col("e") > 0, F.col("e")).otherwise(1.0)) / float(np.log(K.LOG_BASE)))))
    return valid.groupBy("mask", bin_.cast("long").alias("bin"), F.least("observed", F.lit(float(K.OBSERVED - 1))).cast("long").alias("observed")).agg(F.count("*").alias("n"))


def loop_fdr(histogram: DataFrame, inv_fdr: float = 10.0) -> DataFrame:
    """(mask, bin, threshold, observed, fdr): thresholds and rates; a table of MASKS by LAMBDAS rows of counts."""
    rows = histogram.toPandas()  # at most 4 x LAMBDAS x OBSERVED counts
    out = []
    for (mask, b), part in rows.groupby(["mask", "bin"]):
        top = int(part["observed"].max()) + 2
        counts = np.zeros(top + 1)
        counts[0] = b
        np.add.at(counts, part["observed"].to_numpy() + 1, part["n"].to_numpy())
        threshold, rate, _ = K.fdr_table(counts, inv_fdr)
        out += [(mask, int(b), int(threshold), k, float(r)) for k, r in enumerate(rate)]
    return histogram.sparkSession.createDataFrame(out, "mask string, bin long, threshold long, observed long, fdr double")


def loop_enriched(kernel: DataFrame, table: DataFrame) -> DataFrame:
    """Cells whose observed count is over all four thresholds, with the sum of their rates."""
    out = kernel.where(~F.isnan("observed"))
    for m in K.MASKS:
        bin_ = F.least(F.lit(K.LAMBDAS - 1), F.greatest(F.lit(0), F.floor(F.ln(F.when(F.col(m) > 0, F.col(m)).otherwise(1.0)) / float(np.log(K.LOG_BASE))))).cast("long")
        own = table.where(F.col("mask") == m).select(F.col("bin").alias("b__"), F.col("observed").alias("o__"), F.col("threshold").alias("t__"), F.col("fdr").alias(f"fdr_{m}"))
        joined = out.where(~F.isnan(m)).withColumns({"b__": bin_, "o__": F.col("observed").cast("long")}).join(F.broadcast(own), ["b__", "o__"])
        out = joined.where(F.col("observed") > F.col("t__")).drop("b__", "o__", "t__")
    return out


def loop_coalesce(pixels: DataFrame, res: int, radius: int) -> DataFrame:
    """(chr, x, y, radius, pixels, observed, i, j) of greedy clusters of called pixels; (i, j) is the strongest pixel's bin.

    Groups are islands: pixels whose circles of `radius` overlap along x. Clusters grow, so each group tells the span that its
    circles covered; groups whose spans overlap are one in the next turn, until none do. No circle ever reached another
    group's pixel then, so the clusters are those of the whole chromosome in one pass. Spans are a row a group.
    """
    half = res // 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, o = (rows[c].to_numpy() for c in ("i", "j", "observed"))
        found = K.clusters(i * res, j * res, o, radius)
        chr_, group = rows["chr"].iloc[0], rows["group__"].iloc[0]
        out = [(chr_, c.x + half, c.y + half, c.radius, len(c.members), o[c.members[0]], i[c.members[0]], j[c.members[0]], group, *c.span) for c in found]
        return pd.DataFrame(out, columns=["chr", "x", "y", "radius", "pixels", "observed", "i", "j", "group__", "x1", "x2"])

    schema = "chr long, x long, y long, radius long, pixels long, observed double, i long, j long, group__ long, x1 long, x2 long"
    keys = ["chr", "x1", "x2"]
    at = pixels.select("chr", "i", "j", "observed", (F.col("i") * res - radius).alias("x1"), (F.col("i") * res + radius).alias("x2"))
    grouped = stored(at.join(islands(at).withColumnRenamed("island__", "group__"), keys).drop("x1", "x2"))
    while True:
        found = stored(grouped.groupBy("chr", "group__").applyInPandas(run, schema))
        spans = found.groupBy("chr", "group__").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
        turned = stored(spans.join(islands(spans), keys).select("chr", "group__", "island__"))
        if turned.count() == turned.select("chr", "island__").distinct().count():
            discard(grouped, turned)
            return found.drop("group__", "x1", "x2")
        new = stored(grouped.join(turned, ["chr", "group__"]).drop("group__").withColumnRenamed("island__", "group__"))
        discard(grouped, found, turned)
        grouped = new


def loop_filter(enriched: DataFrame, sides: float = 1.5, corner: float = 1.75, donut_corner: float = 2.0, fdr_sum: float | None = None) -> DataFrame:
    """Observed over expected: horizontal and vertical at `sides`, donut and lower left at `corner`, one of them at `donut_corner`.

    With fdr_sum, a loop must also have more than one pixel, or rates that add up to at most that.
    """
    o = F.col("observed")
    strong = (o > donut_corner * F.col("donut")) | (o > donut_corner * F.col("bl"))
    kept = enriched.where((o > sides * F.col("h")) & (o > sides * F.col("v")) & (o > corner * F.col("donut")) & (o > corner * F.col("bl")) & strong)
    if fdr_sum is None:
        return kept
    return kept.where((F.col("pixels") > 1) | (sum((F.col(f"fdr_{m}") for m in K.MASKS), F.lit(0.0)) <= fdr_sum))


def loop_calls(enriched: DataFrame, res: int, radius: int, **limits: float) -> DataFrame:
    """Clusters of enriched pixels whose strongest pixel passes `loop_filter`, with its expectations and rates."""
    found = loop_coalesce(enriched, res, radius)
    return loop_filter(found.join(enriched.drop("observed"), ["chr", "i", "j"]), **limits)


def not_enriched(kernel: DataFrame, most: float = 1.3) -> DataFrame:
    """(chr, i, j) of cells whose observed count is under `most` times each of the four expectations."""
    low = [F.col("observed") < most * F.col(m) for m in K.MASKS]
    return kernel.where(low[0] & low[1] & low[2] & low[3]).select("chr", "i", "j")


def loop_difference(own: DataFrame, other: DataFrame, other_kernel: DataFrame, other_cells: DataFrame, radius: float, most: float = 1.3) -> DataFrame:
    """Loops (chr, i, j) without a loop of the other map within `radius` bins, that are not enriched in that map.

    A loop where the other map has no cell at all is not enriched there. Both lists are joined by cells of `radius`
    bins, nine for a loop, so no pair of distant loops is made.
    """
    width = max(1, int(radius))
    near = "explode(sequence({0} div {1} - 1, {0} div {1} + 1))"
    a = own.select("chr", "i", "j").distinct().withColumns({"ci": F.expr(near.format("i", width))}).withColumn("cj", F.expr(near.format("j", width)))
    b = other.select("chr", F.col("i").alias("oi"), F.col("j").alias("oj"), F.expr(f"i div {width}").alias("ci"), F.expr(f"j div {width}").alias("cj")).distinct()
    close = F.pow(F.col("i") - F.col("oi"), F.lit(2.0)) + F.pow(F.col("j") - F.col("oj"), F.lit(2.0)) <= float(radius) ** 2
    kept = a.join(b, ["chr", "ci", "cj"]).where(close).select("chr", "i", "j").distinct()
    alone = own.join(kept, ["chr", "i", "j"], "left_anti")
    seen = other_cells.where("chr1 = chr2").select(F.col("chr1").alias("chr"), F.col("bin_x").alias("i"), F.col("bin_y").alias("j"))
    enriched = seen.join(not_enriched(other_kernel, most), ["chr", "i", "j"], "left_anti")
    return alone.join(enriched, ["chr", "i", "j"], "left_anti")


def loop_low_coverage(pixels: DataFrame, bad_bins: DataFrame, reach: int = 5) -> DataFrame:
    """Drops pixels with an excluded bin (chr, bin) within `reach` bins on either axis."""
    near = bad_bins.select("chr", F.explode(F.expr(f"sequence(bin - {reach}, bin + {reach})")).alias("k")).distinct()
    out = pixels
    for axis in ("i", "j"):
        out = out.join(near.withColumnRenamed("k", axis), ["chr", axis], "left_anti")
    return out


def bins_without_value(vectors: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    """(chr, bin) of a bin size's bins with no value of the vectors (chr, bin, value), or NaN."""
    every = chroms.select(F.col("idx").alias("chr"), F.explode(F.expr(f"sequence(0L, (len - 1) div {bin_size})")).alias("bin"))
    return every.join(vectors.where("value is not null and not isnan(value)").select("chr", "bin"), ["chr", "bin"], "left_anti")


def loop_pvalues(kernel: DataFrame) -> DataFrame:
    """(chr, i, j, observed, p_bl, p_donut, p_h, p_v): Poisson upper tails of the four expectations."""

    @F.pandas_udf("double")
    def tail(o: pd.Series, e: pd.Series) -> pd.Series:
        known = np.isfinite(o.to_numpy(float))
        found = K.upper_tails(np.where(known, o.to_numpy(float), 0).astype(np.int64), e.to_numpy(float))
        return pd.Series(np.where(known, found, np.nan))

    return kernel.select("chr", "i", "j", "observed", *(tail("observed", m).alias(f"p_{m}") for m in K.MASKS))


def _expectation_row(e: str) -> Column:
    """Row of an expectation in the second generation's tables: ln e over ln LOG_BASE, from ROWS_BELOW below one on."""
    row = F.floor(F.ln(F.col(e)) / float(np.log(K.LOG_BASE))) + ROWS_BELOW
    return F.when(F.col(e) > 0, F.least(F.lit(ROWS - 1), F.greatest(F.lit(0), row))).otherwise(0).cast("long")


def loop_significance(kernel: DataFrame) -> DataFrame:
    """loop_pvalues with the rows row_bl, row_donut, row_h and row_v that the expectations fall into."""
    p = loop_pvalues(kernel).drop("observed")
    return kernel.select("chr", "i", "j", "observed", *(_expectation_row(m).alias(f"row_{m}") for m in K.MASKS)).join(p, ["chr", "i", "j"])


def loop_thresholds(tested: DataFrame, rate: float = 0.1) -> DataFrame:
    """(mask, row, tests, threshold): largest p-value called at a false discovery rate, by Benjamini and Hochberg, in each row.

    A p-value's place k is the least number of calls that allows it, ceil(p * tests / rate); the threshold allows the most
    calls N such that N p-values have a place up to N. Places are counted, and added up by a thousand parts of
    a row before they are added up inside one, so no task orders a whole row.
    """
    stacked = tested.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col(f"row_{m}").alias("row"), F.col(f"p_{m}").alias("p")) for m in K.MASKS))).alias("t")).select("t.*").where("p is not null and not isnan(p)")
    tests = stacked.groupBy("mask", "row").agg(F.count("*").alias("tests"))
    place = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("tests") / rate)).cast("long")
    low = stacked.where(F.col("p") <= rate).join(F.broadcast(tests), ["mask", "row"])
    counts = low.groupBy("mask", "row", "tests", place.alias("k")).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("k") * 1000 / F.col("tests")))
    parts = counts.groupBy("mask", "row", "part").agg(F.sum("n").alias("n"))
    before = parts.select("mask", "row", "part", (F.sum("n").over(Window.partitionBy("mask", "row").orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("mask", "row", "part").orderBy("k")
    upto = counts.withColumn("upto", F.sum("n").over(inside)).join(before, ["mask", "row", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    most = upto.where("upto >= k").groupBy("mask", "row").agg(F.max("upto").alias("calls"))
    return tests.join(most, ["mask", "row"], "left").select("mask", "row", "tests", (F.coalesce("calls", F.lit(0)) * rate / F.col("tests")).alias("threshold"))


def loop_significant(tested: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells whose four p-values are within their rows' thresholds; at most four times ROWS thresholds."""
    out = tested
    for m in K.MASKS:
        own = thresholds.where(F.col("mask") == m).select(F.col("row").alias(f"row_{m}"), F.col("threshold").alias("t__"))
        out = out.join(F.broadcast(own), f"row_{m}").where(F.col(f"p_{m}") <= F.col("t__")).drop("t__")
    return out.select("chr", "i", "j", "observed", *(f"p_{m}" for m in K.MASKS))


def directionality(cells: DataFrame, gap: int = 7) -> DataFrame:
    """(chr, bin_size, i, d, value): (A - B) / (A + B) of upstream and downstream cells at the same distance."""
    up = cells.where("chr1 = chr2").select("bin_size", F.col("chr1").alias("chr"), F.col("bin_y").alias("i"), (F.col("bin_y") - F.col("bin_x")).alias("d"), F.col("counts").alias("a"))
    down = cells.where("chr1 = chr2").select("bin_size", F.col("chr1").alias("chr"), F.col("bin_x").alias("i"), (F.col("bin_y") - F.col("bin_x")).alias("d"), F.col("counts").alias("b"))
    both = up.where(F.col("d") >= gap).join(down.where(F.col("d") >= gap), ["bin_size", "chr", "i", "d"], "full").na.fill(0.0, ["a", "b"])
    return both.where("a + b > 0").select("chr", "bin_size", "i", "d", ((F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("value"))


def thinned(contacts: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Binomial thinning of counts, seeded by each cell's key, so that a repeated task draws the same."""

    @F.pandas_udf("double")
    def draw(key: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng([seed, int(k) & 0xFFFFFFFF, int(k) >> 32 & 0xFFFFFFFF]).binomial(int(c), share)) for k, c in zip(key, counts, strict=True)])

    kept = contacts.withColumn("counts", draw(F.xxhash64("chr1", "chr2", "bin_size", "bin_x", "bin_y"), "counts"))
    return kept.where("counts > 0")
