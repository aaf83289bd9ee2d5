"""Edits of a scaffold order: ordered rows (grp, ord, signed_id, length), written as window and conditional columns.

A scaffold order can hold millions of pieces in a draft assembly, so edits are DataFrame steps as well; `History` keeps
the states for undo and redo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["grp", "ord", "signed_id", "length"]


def _renumber(order: DataFrame, *by) -> DataFrame:
    return order.withColumn("ord", F.row_number().over(Window.orderBy(*by)).cast("long")).select(*COLUMNS)


def cut(order: DataFrame, id_: int, a: int, b: int) -> DataFrame:
    """Splits scaffold id_ at [a, b) into left, middle and right: later ids grow by two, the middle becomes a group at the end."""
    size = F.abs("signed_id")
    sign = F.when(F.col("signed_id") < 0, -1).otherwise(1)
    moved = order.withColumn("signed_id", F.when(size > id_, sign * (size + 2)).otherwise(F.col("signed_id")))
    hit = F.abs("signed_id") == id_
    left, middle, right = (F.lit(0), F.lit(a)), (F.lit(a), F.lit(b)), (F.lit(b), F.col("length"))
    parts = [F.struct((F.lit(id_ + k) * sign).cast("long").alias("signed_id"), (y - x).cast("long").alias("length"), F.lit(k).alias("k")) for k, (x, y) in enumerate((left, middle, right))]
    turned = F.when(F.col("signed_id") < 0, F.array(*parts[::-1])).otherwise(F.array(*parts))
    whole = F.array(F.struct("signed_id", "length", F.lit(0).alias("k")))
    rows = moved.select("grp", "ord", F.posexplode(F.when(hit, turned).otherwise(whole)).alias("at", "p"))
    last = order.agg((F.max("grp") + 1).alias("last"))
    split = rows.crossJoin(F.broadcast(last)).withColumn("debris", F.col("p.k") == 1)
    out = split.select(F.when(F.col("debris"), F.col("last")).otherwise(F.col("grp")).alias("grp"), "ord", "at", "debris", "p.signed_id", "p.length")
    return _renumber(out, "debris", "ord", "at")


def invert(order: DataFrame, first: int, last: int) -> DataFrame:
    """Reverses the run of places first..last and negates its ids; groups inside are reversed, too."""
    inside = F.col("ord").between(first, last)
    place = F.when(inside, first + last - F.col("ord")).otherwise(F.col("ord"))
    out = order.withColumns({"signed_id": F.when(inside, -F.col("signed_id")).otherwise(F.col("signed_id")), "place": place})
    return _renumber(out, "place")


def move(order: DataFrame, first: int, last: int, after: int) -> DataFrame:
    """Puts the run of places first..last behind place `after` (0: on top), into the group found there."""
    inside = F.col("ord").between(first, last)
    target = order.where(F.col("ord") == max(after, 1)).agg(F.min("grp").alias("target"))
    key = F.when(inside, F.lit(after + 0.5)).otherwise(F.col("ord").cast("double"))
    out = order.crossJoin(F.broadcast(target)).withColumns({"key": key, "grp": F.when(inside, F.col("target")).otherwise(F.col("grp"))})
    return _renumber(out.withColumnRenamed("ord", "was").withColumn("ord", F.col("was")), "key", "was")


def merge(order: DataFrame, first_group: int, last_group: int) -> DataFrame:
    """Joins the consecutive groups first..last into the first."""
    return order.withColumn("grp", F.when(F.col("grp").between(first_group, last_group), first_group).otherwise(F.col("grp"))).select(*COLUMNS)


def split(order: DataFrame, after: int) -> DataFrame:
    """Breaks the group that holds place `after` behind it."""
    own = order.where(F.col("ord") == after).select(F.col("grp").alias("g"))
    out = order.crossJoin(F.broadcast(own))
    later = (F.col("grp") > F.col("g")) | ((F.col("grp") == F.col("g")) & (F.col("ord") > after))
    return out.withColumn("grp", F.col("grp") + F.when(later, 1).otherwise(0)).select(*COLUMNS)


def toggle(order: DataFrame, first: int, last: int) -> DataFrame:
    """One group a scaffold inside the run, later groups behind them."""
    cuts = F.when(F.col("ord").between(first, last), 1).otherwise(0)
    changed = F.col("grp") != F.lag("grp").over(Window.orderBy("ord"))
    fresh = F.when(changed | (cuts == 1) | (F.lag(cuts).over(Window.orderBy("ord")) == 1), 1).otherwise(0)
    marked = order.withColumn("fresh", F.coalesce(fresh, F.lit(0)))
    return marked.withColumn("grp", (F.sum("fresh").over(Window.orderBy("ord")) + 1).cast("long")).select(*COLUMNS)


def phase_merge(order: DataFrame, group: int, other: int) -> DataFrame:
    """Appends haplotype row `other` to `group`, and the partners (even and odd ids) of its pieces to the partner row of `group`."""
    partner = F.when(F.abs("signed_id") % 2 == 0, F.abs("signed_id") - 1).otherwise(F.abs("signed_id") + 1)
    mirror = order.where(F.col("grp") == other).select(partner.alias("pid"), F.lit(True).alias("mirrored"))
    alt = order.where(F.col("grp") == group).select(partner.alias("pid")).join(order.select(F.abs("signed_id").alias("pid"), F.col("grp").alias("alt")), "pid").agg(F.min("alt").alias("alt"))
    out = order.withColumn("pid", F.abs("signed_id")).join(F.broadcast(mirror), "pid", "left").crossJoin(F.broadcast(alt))
    grp = F.when(F.col("grp") == other, F.lit(group)).when(F.col("mirrored") & F.col("alt").isNotNull(), F.col("alt")).otherwise(F.col("grp"))
    return _renumber(out.withColumn("grp", grp.cast("long")), "grp", "ord")


class History:
    """States for undo and redo."""

    def __init__(self, first: DataFrame):
        self.states, self.at = [first], 0

    def push(self, state: DataFrame) -> DataFrame:
        self.states = [*self.states[: self.at + 1], state]
        self.at += 1
        return state

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.states[self.at]

    def redo(self) -> DataFrame:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.states[self.at]
