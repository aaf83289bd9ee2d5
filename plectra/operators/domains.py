"""Square domains along the diagonal, called in windows that overlap by half.

Windows are groups of a bounded size. What they find is put together by islands of domains that touch, each a group
of its own, so no group holds a chromosome unless domains touch all along it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectra.kernels import dense as D
from plectra.operators.intervals import islands
from plectra.plans.storage import stored

#: Agreement of signs and variance of sure domains; agreements tried in turn for the others; bins that those must be over.
SURE_SIGN, SURE_VARIANCE = 0.5, 0.2
OTHER_SIGNS = (0.4, 0.3, 0.2, 0.1, 0.0)
SMALLEST = 60
#: Bins within which corners are taken for one domain, in two rounds.
ROUNDS = (5, 10)
VALUES = ["score", "up_var", "lo_var", "up_sign", "lo_sign"]
_DOUBLES = ", ".join(f"{c} double" for c in VALUES)


def _starts(width: int) -> Column:
    """First bins of the windows that hold bins i to j of n: every half width, and the last one ends with the chromosome."""
    step = width // 2
    even = f"transform(filter(sequence(greatest(0L, (j - {width}) div {step}), i div {step}), w -> w * {step} + {width} < n and j <= w * {step} + {width}), w -> w * {step})"
    last = f"greatest(0L, n - {width})"
    return F.explode(F.expr(f"array_union({even}, if(i >= {last}, array({last}), array()))"))


def _windows(cells: DataFrame, chroms: DataFrame, width: int) -> DataFrame:
    """Cells of one chromosome by windows of width + 1 bins."""
    lengths = chroms.select(F.col("idx").alias("chr1"), "len")
    own = cells.where("chr1 = chr2").join(F.broadcast(lengths), "chr1")
    named = own.select("bin_size", F.col("chr1").alias("chr"), F.expr("(len - 1) div bin_size + 1").alias("n"), F.col("bin_x").alias("i"), F.col("bin_y").alias("j"), F.col("counts").alias("value"))
    return named.where(f"j - i <= {width}").withColumn("start", _starts(width))


def _blocks(rows: pd.DataFrame, width: int, gap: int) -> D.Blocks:
    start = int(rows["start"].iloc[0])
    size = min(width, int(rows["n"].iloc[0]) - start) + 1
    return D.blocks(D.directionality(D.dense(rows["i"].to_numpy() - start, rows["j"].to_numpy() - start, rows["value"].to_numpy(), size), gap))


def found_blocks(cells: DataFrame, chroms: DataFrame, width: int = 2000, gap: int = 7) -> DataFrame:
    """(chr, bin_size, start, sign, variance, i, j, VALUES) of the blocks that each window finds, sure and other ones.

    Sure blocks have the sign SURE_SIGN and the variance SURE_VARIANCE. Others have no variance, and the largest of OTHER_SIGNS
    at which any window of the chromosome finds one. A window only tells what it finds at its own largest such sign: at smaller ones it has
    no say, since the chromosome stops where its first window finds something.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = _blocks(rows, width, gap)
        keys = {k: rows[k].iloc[0] for k in ("chr", "bin_size", "start")}

        def told(sign: float, variance: float | None) -> pd.DataFrame:
            i, j = D.corners(b, sign, variance)
            place = {"i": i + keys["start"], "j": j + keys["start"]}
            return pd.DataFrame({**{k: np.full(len(i), v) for k, v in keys.items()}, "sign": sign, "variance": np.nan if variance is None else variance, **place, **{v: getattr(b, v)[i, j] for v in VALUES}})

        out = [told(SURE_SIGN, SURE_VARIANCE)]
        for sign in OTHER_SIGNS:
            others = told(sign, None)
            if len(others):
                out.append(others)
                break
        return pd.concat(out)

    schema = f"chr long, bin_size long, start long, sign double, variance double, i long, j long, {_DOUBLES}"
    found = stored(_windows(cells, chroms, width).groupBy("chr", "bin_size", "start").applyInPandas(run, schema))
    found = found.withColumn("variance", F.nanvl("variance", F.lit(None).cast("double")))
    most = found.where("variance is null").groupBy("chr", "bin_size").agg(F.max("sign").alias("most__"))
    kept = found.join(F.broadcast(most), ["chr", "bin_size"], "left")
    return kept.where("variance is not null or sign = most__").drop("most__")


def _near(low: np.ndarray, high: np.ndarray, at: int, reach: int) -> np.ndarray:
    return (np.abs(low - at) < reach) | (np.abs(high - at) < reach)


def binned(found: list[tuple], reach: int) -> list[tuple]:
    """Blocks (i, j, *values) within `reach` bins of an earlier one's range on both axes join it, the first such range.

    A range gives its largest i and j and the means of its values.
    """
    bounds = np.empty((4, len(found)), np.int64)  # least and largest i, least and largest j of each range
    members: list[list[tuple]] = []
    for block in found:
        i, j = block[:2]
        seen = bounds[:, : len(members)]
        hit = np.flatnonzero(_near(seen[0], seen[1], i, reach) & _near(seen[2], seen[3], j, reach))
        if len(hit):
            k = int(hit[0])
            members[k].append(block)
            bounds[:, k] = min(seen[0, k], i), max(seen[1, k], i), min(seen[2, k], j), max(seen[3, k], j)
        else:
            bounds[:, len(members)] = i, i, j, j
            members.append([block])
    return [(int(bounds[1, k]), int(bounds[3, k]), *(float(np.mean(v)) for v in list(zip(*m, strict=True))[2:])) for k, m in enumerate(members)]


def without_conflicts(sure: list[tuple], others: list[tuple]) -> list[tuple]:
    """Sure blocks, then each other one with no edge of a block taken before between its own edges, these included."""
    out, edges = list(sure), sorted({e for b in sure for e in b[:2]})
    for block in others:
        at = bisect_left(edges, block[0])
        if at == len(edges) or edges[at] > block[1]:
            out.append(block)
            edges[at:at] = sorted({block[0], block[1]})
    return out


def domains(cells: DataFrame, chroms: DataFrame, width: int = 2000, gap: int = 7, smallest: int = SMALLEST) -> DataFrame:
    """(chr, bin_size, start, end, VALUES) of domains: sure blocks, and others over `smallest` bins that do not conflict with them.

    Sure blocks go by window and place, those found in two windows twice; others by place, equal ones once. Corners of one place are put
    together in two ROUNDS. Blocks of two islands are too far apart for either step.
    """
    found = stored(found_blocks(cells, chroms, width, gap))
    margin = -(-max(ROUNDS) // 2)
    chrom = F.struct("bin_size", "chr").alias("chr")
    wide = found.select(chrom, (F.col("i") - margin).alias("x1"), (F.col("j") + margin).alias("x2"))
    island = islands(wide).select("chr.bin_size", "chr.chr", (F.col("x1") + margin).alias("i"), (F.col("x2") - margin).alias("j"), "island__")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "i", "j"])
        told = [tuple(r) for r in rows[["i", "j", *VALUES]].itertuples(index=False)]
        certain = rows["variance"].notna().tolist()
        sure = [t for t, c in zip(told, certain, strict=True) if c]
        others = {t for t, c in zip(told, certain, strict=True) if not c and t[1] - t[0] > smallest}
        out = without_conflicts(sure, sorted(others - set(sure)))
        for reach in ROUNDS:
            out = binned(out, reach)
        size = rows["bin_size"].iloc[0]
        return pd.DataFrame([(rows["chr"].iloc[0], size, i * size, j * size, *v) for i, j, *v in out], columns=["chr", "bin_size", "start", "end", *VALUES])

    joined = found.join(island, ["bin_size", "chr", "i", "j"])
    return joined.groupBy("bin_size", "chr", "island__").applyInPandas(run, f"chr long, bin_size long, start long, end long, {_DOUBLES}")


def domain_scores(cells: DataFrame, chroms: DataFrame, boxes: DataFrame, width: int = 2000, gap: int = 7) -> DataFrame:
    """(chr, start1, end1, start2, end2, score) of given boxes: the largest block score inside, over all windows that hold them.

    boxes: (chr, start1, end1, start2, end2) in bases, ends left out; equal ones are one. Scores are taken as they are, without limits.
    A box that no window with cells holds (longer than half a width, or off the map) is left out.
    """
    keys = ["chr", "start1", "end1", "start2", "end2"]
    sizes = cells.select("bin_size").distinct()
    lengths = F.broadcast(chroms.select(F.col("idx").alias("chr"), "len"))
    at = boxes.select(*keys).distinct().crossJoin(F.broadcast(sizes)).join(lengths, "chr").where("start1 >= 0 and end2 <= len")
    place = at.selectExpr(*keys, "bin_size", "(len - 1) div bin_size + 1 AS n", "start1 div bin_size AS a1", "(end1 - 1) div bin_size AS b1", "start2 div bin_size AS a2", "(end2 - 1) div bin_size AS b2")
    held = place.withColumns({"i": F.least("a1", "a2"), "j": F.greatest("b1", "b2") + 1}).where(f"j - i <= {width}").withColumn("start", _starts(width))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame(columns=[*keys, "score"])
        score, start = _blocks(rows, width, gap).score, int(rows["start"].iloc[0])
        out = [float(score[a - start : b - start + 1, c - start : d - start + 1].max(initial=-np.inf)) for a, b, c, d in asked[["a1", "b1", "a2", "b2"]].itertuples(index=False)]
        return asked[keys].assign(score=out)

    by = ["chr", "bin_size", "start"]
    scored = _windows(cells, chroms, width).groupBy(*by).cogroup(held.toDF(*held.columns).groupBy(*by)).applyInPandas(run, "chr long, start1 long, end1 long, start2 long, end2 long, score double")
    return scored.groupBy(*keys).agg(F.max("score").alias("score"))
