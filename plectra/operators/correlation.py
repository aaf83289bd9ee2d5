"""Correlation of the rows of large symmetric matrices, and its leading eigenvectors, without a group that holds a chromosome.

Rows are centred twice, by the means of the columns and by their own: c_ik = m_ik - mean_k - g_i. The correlation is made by
pairs of row tiles. Its eigenvectors come from products of the sparse cells with a few vectors at a time (subspace
iteration): the correlation itself is never formed, and the driver sees a small Gram matrix for each chromosome.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.operators.balancing import Matrices
from plectra.plans.storage import discard, stored

#: Rows of a tile at most, places of a dense strip, and columns multiplied at a time.
TILE, STRIP, COLUMNS = 512, 8_000_000, 4096
#: Vectors iterated together, rounds at most, and the residual, relative to the eigenvalue, that ends them.
VECTORS, ROUNDS, RESIDUAL = 8, 100, 1e-8


def _lengths(m: Matrices, chroms: DataFrame) -> DataFrame:
    """(m, n): bins of each matrix."""
    own = m.names.join(chroms.select(F.col("idx").alias("chr"), "len"), "chr")
    return own.select("m", F.expr("(len - 1) div bin_size + 1").alias("n"))


def _tile(rows: pd.DataFrame, tile: int, height: int, first: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    out[rows["bin"].to_numpy() - tile * height, rows["at"].to_numpy() - first] = rows["counts"].to_numpy()
    return out


def pearson(oe: DataFrame, chroms: DataFrame, tile: int = TILE) -> DataFrame:
    """(bin_size, chr, i, j, value): correlation of every pair i <= j of occupied rows of O/E.

    A group is a pair of tiles of rows and holds their cells alone; a tile has fewer rows where rows are long. Rows whose values are
    all alike correlate with themselves only.
    """
    cells = oe.withColumnRenamed("value", "counts")
    m = Matrices(cells)
    schema = "bin_size long, chr long, i long, j long, value double"
    if not m.keys:
        return oe.sparkSession.createDataFrame([], schema)
    lengths = F.broadcast(_lengths(m, chroms))  # a row a matrix
    means = m.rows.join(lengths, "m").select("m", F.col("bin").alias("at"), (F.col("total") / F.col("n")).alias("mean"))
    sums = F.broadcast(means.groupBy("m").agg(F.sum("mean").alias("m1"), F.sum(F.col("mean") ** 2).alias("m2")))
    placed = m.links.join(means, ["m", "at"]).join(lengths, "m").join(sums, "m")
    height = F.least(F.lit(tile), F.greatest(F.lit(1), F.expr(f"cast({STRIP} div n as int)"))).cast("long")
    placed = placed.withColumn("height", height).withColumn("own", F.expr("bin div height"))
    other = F.explode(F.expr("sequence(0L, (n - 1) div height)"))
    pairs = placed.withColumn("other", other).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number, a, b, n, h = (int(rows[c].iloc[0]) for c in ("m", "a", "b", "n", "height"))
        m1, m2 = rows["m1"].iloc[0], rows["m2"].iloc[0]
        mean = np.zeros(n)
        mean[rows["at"].to_numpy()] = rows["mean"].to_numpy()
        parts = [rows[rows["own"] == t] for t in (a, b)]
        product, squares, along, totals = np.zeros((h, h)), np.zeros((2, h)), np.zeros((2, h)), np.zeros((2, h))
        for first in range(0, n, COLUMNS):
            width = min(COLUMNS, n - first)
            near = [p[(p["at"] >= first) & (p["at"] < first + width)] for p in parts]
            x, y = (_tile(p, t, h, first, width) for p, t in zip(near, (a, b), strict=True))
            product += x @ y.T
            for k, z in enumerate((x, y)):
                squares[k] += (z**2).sum(1)
                along[k] += z @ mean[first : first + width]
                totals[k] += z.sum(1)
        # Sums of products of centred rows, from those of the rows as they are.
        off = (totals - m1) ** 2 / n
        spread = np.sqrt(np.maximum(squares - 2 * along + m2 - off, 0))
        cov = product - along[0][:, None] - along[1][None, :] + m2 - np.outer(totals[0] - m1, totals[1] - m1) / n
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.clip(cov / np.outer(spread[0], spread[1]), -1, 1)
        i, j = np.meshgrid(a * h + np.arange(h), b * h + np.arange(h), indexing="ij")
        c[i == j] = 1.0
        held = np.outer(*(np.isin(np.arange(h) + t * h, p["bin"].to_numpy()) for t, p in zip((a, b), parts, strict=True)))
        keep = held & (i <= j) & ~np.isnan(c)
        return pd.DataFrame({"m": number, "i": i[keep], "j": j[keep], "value": c[keep]})

    # A pair of equal tiles holds its rows once; in other pairs both tiles' cells meet.
    done = pairs.groupBy("m", "a", "b").applyInPandas(run, "m int, i long, j long, value double")
    return done.join(F.broadcast(m.names), "m").select("bin_size", "chr", "i", "j", "value")


def eigenvector(oe: DataFrame, chroms: DataFrame, which: int = 0, centred: bool = True, vectors: int = VECTORS, rounds: int = ROUNDS) -> DataFrame:
    """(bin_size, chr, bin, value) of an eigenvector of the correlation (largest eigenvalue first); bins without data are left out.

    The sign is fixed: the entry with the largest magnitude, the first of equals at nine digits, is positive. Vectors are
    centred, if asked for, after that. All chromosomes iterate together until the residual of the wanted vector is small.
    """
    cells = oe.withColumnRenamed("value", "counts")
    m = Matrices(cells)
    if not m.keys:
        return oe.sparkSession.createDataFrame([], "bin_size long, chr long, bin long, value double")
    k = max(vectors, which + 2)
    lengths = F.broadcast(_lengths(m, chroms))
    base = m.rows.join(lengths, "m").withColumn("mean", F.col("total") / F.col("n"))
    sums = F.broadcast(base.groupBy("m").agg(F.sum("mean").alias("m1"), F.sum(F.col("mean") ** 2).alias("m2")))
    along = m.times(base.select("m", "bin", F.col("mean").alias("t"))).withColumnRenamed("q", "along")
    squares = m.links.groupBy("m", "bin").agg(F.sum(F.col("counts") ** 2).alias("squares"))
    g = (F.col("total") - F.col("m1")) / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.expr("squares - 2 * along + m2 - (total - m1) * (total - m1) / n")))
    base = base.join(sums, "m").join(along, ["m", "bin"]).join(squares, ["m", "bin"])
    base = stored(base.select("m", "bin", "mean", g.alias("g"), F.when(spread > 1e-9 * F.sqrt("squares"), 1 / spread).otherwise(0.0).alias("scale")))

    xs = [f"x{c}" for c in range(k)]
    start = [((F.xxhash64("bin", F.lit(c)) % 1000) / 1000.0).alias(x) for c, x in enumerate(xs)]  # any start that depends on the bin alone
    z = stored(base.select("m", "bin", "mean", "g", "scale", *start))
    live, found, values = set(range(len(m.keys))), [], {}
    change = _orthonormal(m, z, xs, None)[0]
    for turn in range(rounds):
        x = stored(_combined(m, z, xs, change, live))
        y = _times(m, x.select("m", "bin", *((F.col(c) * F.col("scale")).alias(c) for c in xs)), xs)
        own = m.sums(x, **{f"s{c}": F.sum(F.col(c) * F.col("scale")) for c in xs}, **{f"g{c}": F.sum(F.col(c) * F.col("scale") * F.col("g")) for c in xs})
        u = x.join(y, ["m", "bin"])
        u = m.given(u, own).select("m", "bin", "mean", *(F.expr(f"q{c} - mean * s{c} - g{c}").alias(c) for c in xs))
        u = stored(u)
        drift = m.sums(u, **{f"d{c}": F.sum(F.col(c) * F.col("mean")) for c in xs})
        z = x.join(_times(m, u, xs), ["m", "bin"])
        old = [F.col(c).alias(f"o{c}") for c in xs]
        z = stored(m.given(z, drift).select("m", "bin", "mean", "g", "scale", *old, *(F.expr(f"(q{c} - d{c}) * scale").alias(c) for c in xs)))
        change, ritz = _orthonormal(m, z, xs, which)
        ended = {i for i in live if ritz[i][2] <= RESIDUAL or turn == rounds - 1}
        if ended:
            # The wanted vector as a combination of the columns before this round's product.
            parts = m.given(z, {i: {f"w{c}": float(v) for c, v in zip(xs, ritz[i][1], strict=True)} for i in ended})
            found.append(parts.select("m", "bin", F.expr(" + ".join(f"o{c} * w{c}" for c in xs)).alias("value")))
            values |= {i: ritz[i][0] for i in ended}
        live -= ended
        discard(x, u)
        if not live:
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = stored(out)
    peak = F.max_by(F.signum("value"), F.struct(F.round(F.abs("value"), 9), -F.col("bin")))
    signs = m.sums(out, sign=peak, mean=F.avg("value"))
    for s in signs.values():
        s["sign"], s["mean"] = s["sign"] or 1.0, s["mean"] if centred else 0.0
    out = m.given(out, signs).withColumn("value", F.expr("(value - mean) * sign"))
    return out.join(F.broadcast(m.names), "m").select("bin_size", "chr", "bin", "value")


def _times(m: Matrices, vectors: DataFrame, xs: list[str]) -> DataFrame:
    """(m, bin, q...): the matrices times several vectors in one pass over the cells."""
    other = vectors.select("m", F.col("bin").alias("at"), *xs)
    return m.links.join(other, ["m", "at"]).groupBy("m", "bin").agg(*(F.sum(F.col("counts") * F.col(c)).alias(f"q{c}") for c in xs))


def _combined(m: Matrices, z: DataFrame, xs: list[str], change: dict[int, np.ndarray], live: set[int]) -> DataFrame:
    """The columns of each live matrix combined by its small square matrix."""
    given = m.given(z, {i: {f"r{a}_{b}": float(change[i][a, b]) for a in range(len(xs)) for b in range(len(xs))} for i in live})
    return given.select("m", "bin", "mean", "g", "scale", *(F.expr(" + ".join(f"{c} * r{a}_{b}" for a, c in enumerate(xs))).alias(x) for b, x in enumerate(xs)))


def _orthonormal(m: Matrices, z: DataFrame, xs: list[str], which: int | None) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
    """Of each matrix: what makes its columns orthonormal, and the wanted (value, combination, residual) of the columns before."""
    k = len(xs)
    gram = {f"z{a}_{b}": F.sum(F.col(xs[a]) * F.col(xs[b])) for a in range(k) for b in range(a, k)}
    cross = {} if which is None else {f"c{a}_{b}": F.sum(F.col(f"o{xs[a]}") * F.col(xs[b])) for a in range(k) for b in range(k)}
    change, ritz = {}, {}
    for i, s in m.sums(z, **gram, **cross).items():
        zz = np.array([[s[f"z{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
        values, basis = np.linalg.eigh(zz)
        good = values > 1e-14 * max(values[-1], 1e-300)
        change[i] = basis * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
        if which is not None:
            t = np.array([[s[f"c{a}_{b}"] for b in range(k)] for a in range(k)])
            values, basis = np.linalg.eigh((t + t.T) / 2)
            w, value = basis[:, -1 - which], values[-1 - which]
            residual = w @ zz @ w - 2 * value * (w @ t @ w) + value**2 * (w @ w)
            ritz[i] = (value, w, np.sqrt(max(residual, 0)) / max(abs(value), 1e-300))
    return change, ritz
