"""Places of features at a finer bin size: peaks of the contacts around a feature's middle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.kernels import peaks as K
from plectra.operators.features2d import COORDS
from plectra.plans.storage import stored

#: Bases that a given radius counts at least.
LEAST_RADIUS = 2000


def _cells_around(cells: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(id, size, i, j, counts, normed) of the cells up to radius + window bins around (m1, m2), stored triangle only.

    A feature is exploded into the rows of its window, so the join is by chromosomes and row.
    """
    half = F.col("radius") + window
    rows = asked.withColumns({"half": half, "bin_x": F.explode(F.sequence(F.col("m1") - half, F.col("m1") + half))})
    hit = cells.join(rows, ["chr1", "chr2", "bin_x"]).where(F.abs(F.col("bin_y") - F.col("m2")) <= F.col("half"))
    return hit.select("id", (2 * F.col("half") + 1).alias("size"), (F.col("bin_x") - F.col("m1") + F.col("half")).alias("i"), (F.col("bin_y") - F.col("m2") + F.col("half")).alias("j"), "counts", "normed")


def _peaks(cells: DataFrame, asked: DataFrame, window: int, peaks: int, max_p: float) -> DataFrame:
    """(id, rank, window, u, v, observed, p) of the features that have any; u and v from the window's middle."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["size"].iloc[0])
        raw, normed = np.zeros((n, n)), np.zeros((n, n))
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        raw[i, j], normed[i, j] = rows["counts"].to_numpy(), rows["normed"].to_numpy()
        found = K.local_peaks(raw, normed, window, max_p)[:peaks]
        out = [(rows["id"].iloc[0], k + 1, window, a - n // 2, b - n // 2, o, p) for k, (a, b, o, p) in enumerate(found)]
        return pd.DataFrame(out, columns=["id", "rank", "window", "u", "v", "observed", "p"])

    schema = "id long, rank long, window long, u long, v long, observed double, p double"
    return _cells_around(cells, asked, window).groupBy("id").applyInPandas(run, schema)


def localize(contacts: DataFrame, features: DataFrame, bin_size: int, vectors: DataFrame | None = None, window: int = 1, peaks: int = 1, max_p: float = 0.05) -> DataFrame:
    """(COORDS, rank, window, local_x, local_y, observed, p) of features: their best peaks, `peaks` of each at most.

    features: COORDS, and radius in bases where they have one; without, or with one of 0 or less, the first side's length is taken; distinct ones
    count once. vectors: (chr, bin, value) of that bin size, ones where there are none; a cell of a bin without a value, or of 0, is 0 when normalised.
    Features without a peak are tried once more with twice the window; those that still have none get one row of nulls. local_x and local_y are starts
    of bins in bases, observed the contacts within the window around the peak.
    """
    radius = F.floor(F.coalesce(F.col("radius").cast("double"), F.lit(0.0)) / bin_size).cast("long") if "radius" in features.columns else F.lit(0).cast("long")
    named = features.select(*COORDS, radius.alias("radius")).distinct()
    side = F.expr(f"(end1 - start1) div {bin_size}")
    wide = F.when(F.col("radius") <= 0, side).otherwise(F.greatest("radius", F.lit(LEAST_RADIUS // bin_size).cast("long")))
    places = named.select(*COORDS, wide.alias("radius"), F.expr(f"((start1 + end1) div 2) div {bin_size}").alias("m1"), F.expr(f"((start2 + end2) div 2) div {bin_size}").alias("m2"))
    asked = stored(places.withColumn("id", F.monotonically_increasing_id()))
    cells = contacts.where(F.col("bin_size") == bin_size).select("chr1", "chr2", "bin_x", "bin_y", "counts")
    if vectors is None:
        cells = cells.withColumn("normed", F.col("counts"))
    else:
        for side_ in ("x", "y"):
            own = vectors.select(F.col("chr").alias(f"chr{1 if side_ == 'x' else 2}"), F.col("bin").alias(f"bin_{side_}"), F.col("value").alias(f"f{side_}"))
            cells = cells.join(own, [own.columns[0], own.columns[1]], "left")
        factor = F.col("fx") * F.col("fy")
        cells = cells.select("chr1", "chr2", "bin_x", "bin_y", "counts", F.when((factor != 0) & ~F.isnan(factor), F.col("counts") / factor).otherwise(0.0).alias("normed"))
    first = stored(_peaks(cells, asked, window, peaks, max_p))
    failed = asked.join(first.select("id").distinct(), "id", "left_anti")
    found = first.unionByName(_peaks(cells, failed, 2 * window, peaks, max_p))
    placed = asked.join(found, "id", "left")
    return placed.select(*COORDS, "rank", "window", ((F.col("m1") + F.col("u")) * bin_size).alias("local_x"), ((F.col("m2") + F.col("v")) * bin_size).alias("local_y"), "observed", "p")
