"""Element-wise work on matrices held as cells (i, j, value); places without a cell are 0.

`keys` are columns that tell matrices apart, such as (bin_size, chr).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of either matrix, a's value and b's side by side."""
    on = [*keys, "i", "j"]
    both = a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on, "full")
    return both.na.fill(0.0, ["a", "b"])


def pair_functions() -> dict[str, Column]:
    """What `paired` cells can be combined to."""
    a, b = F.col("a"), F.col("b")
    return {
        "total": a + b, "difference": a - b, "product": a * b, "ratio": ieee_div("b", "a"), "mean": (a + b) / 2,
        "smaller": F.least(a, b), "larger": F.greatest(a, b), "sign": F.signum(a - b), "difference_size": F.abs(a - b),
    }


def transposed(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"i": F.col("j"), "j": F.col("i")})


def flipped(cells: DataFrame, n: Column | str, axis: str = "j") -> DataFrame:
    """The order of columns (axis j) or rows (axis i) of an n x n matrix turned round."""
    return cells.withColumn(axis, (F.col(n) if isinstance(n, str) else n) - 1 - F.col(axis))


def scaled(cells: DataFrame, factor: float) -> DataFrame:
    return cells.withColumn("value", F.col("value") * factor)


def clipped(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Values below `low` or above `high` are set to these; places without a cell stay 0."""
    return cells.withColumn("value", F.least(F.greatest("value", F.lit(low)), F.lit(high)))


def marked(cells: DataFrame, limit: float) -> DataFrame:
    """1 where a value is over the limit; other cells go."""
    return cells.where(F.col("value") > limit).withColumn("value", F.lit(1.0))


def cleaned(cells: DataFrame) -> DataFrame:
    """Without cells that are NaN or infinite."""
    return cells.where(~F.isnan("value") & (F.abs("value") != float("inf")))


def line_sums(cells: DataFrame, keys: list[str], axis: str = "i") -> DataFrame:
    """Sums of rows (axis i) or columns (axis j)."""
    return cells.groupBy(*keys, axis).agg(F.sum("value").alias("value"))


def line_means(cells: DataFrame, keys: list[str], n: Column, axis: str = "i") -> DataFrame:
    """Sums of rows or columns over the n places of a line."""
    return cells.groupBy(*keys, axis).agg((F.sum("value") / F.max(n)).alias("value"))


def row_steps(cells: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Value of the next column less this one's, along rows of an n x n matrix; steps of 0 are left out.

    A cell adds to the step before it and takes from its own, so no row is laid out in full.
    """
    before = cells.where("j > 0").select(*keys, "i", (F.col("j") - 1).alias("j"), "value")
    after = cells.where(F.col("j") < F.col(n) - 1).select(*keys, "i", "j", (-F.col("value")).alias("value"))
    return before.union(after).groupBy(*keys, "i", "j").agg(F.sum("value").alias("value")).where("value <> 0")


def stitched(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """One matrix with `upper` on and above the diagonal and `lower` below it."""
    return upper.where("i <= j").unionByName(lower.where("i > j"))


def standard_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(value - mean) / standard deviation over the stored cells of each matrix; NaN where all are equal."""
    sums = cells.groupBy(*keys).agg(F.avg("value").alias("m__"), F.stddev_pop("value").alias("s__"))
    return cells.join(sums, keys).withColumn("value", ieee_div(F.col("value") - F.col("m__"), F.col("s__"))).drop("m__", "s__")
