"""Running totals over ordered rows without a task that sees them all.

Two levels: rows are dealt into ranges of the order, each range is summed up on its own, the sums of ranges before a range
(a row per range and group) become its carry, and the carry is joined back to the rows. A group with most of the rows is as many
tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectra.plans.storage import stored

#: How values of a kind are gathered, and how a carry and a value of the range join.
GATHER = {"sum": F.sum, "max": F.max, "min": F.min}
JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def ranged(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in ranges of (by, order): adds part__ and at__, the row's range and place in it. Written once, so both stay as they are.

    Equal rows may stand in any order, but always in the same.
    """
    keys = {f"key{k}__": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    dealt = rows.withColumns(keys).repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
    return stored(dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}).drop(*keys))


def prefix(rows: DataFrame, by: list[str], out: str, kind: str, value: Column, inclusive: bool) -> DataFrame:
    """Adds the sum, largest or smallest value of all rows of the group up to a row, or before it; rows come from `ranged`.

    Without any row before, a sum is 0 and the others are null.
    """
    rows = rows.withColumn("value__", value)
    inside = Window.partitionBy("part__", *by).orderBy("at__").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = rows.groupBy("part__", *by).agg(GATHER[kind]("value__").alias("sum__"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("part__", *(F.col(c).alias(f"{c}__") for c in by), GATHER[kind]("sum__").over(before).alias("carry__"))
    same = F.col("a.part__") == F.col("b.part__")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}__"))
    joined = rows.withColumn("own__", GATHER[kind]("value__").over(inside)).alias("a").join(carry.alias("b"), same)
    return joined.select("a.*", JOIN[kind](F.col("b.carry__"), F.col("a.own__")).alias(out)).drop("value__", "own__")


def cumulative(rows: DataFrame, by: list[str], order: list[str | Column], out: str, value: Column, inclusive: bool = True) -> DataFrame:
    """The rows with their running sum."""
    return prefix(ranged(rows, by, order), by, out, "sum", value, inclusive).drop("part__", "at__")
