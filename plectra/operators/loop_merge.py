"""Loops called at several bin sizes, merged into one list.

Finer calls are noisier, so a fine loop must be seen at a coarser size, too, or lie near the diagonal, or be strong; coarse
loops are placed badly, so one stays only where no finer list has a loop near it. Distances are between starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectra.operators.features2d import COORDS, reproducible
from plectra.plans.storage import stored

#: Fixed values of the rules, in bases and counts: from this distance to the diagonal, and up to this count, a loop must be confirmed;
#: by bin size, of the first generation (5, 10 and 25 kb) and of the second (1, 2, 5 and 10 kb).
FIRST_NEAR, FIRST_STRONG = {5000: 110_000}, {5000: 100}
SECOND_NEAR, SECOND_STRONG = {1000: 50_000, 2000: 80_000}, {1000: 20, 2000: 40}
#: Where the finest list is 1 kb and there is none of 2 kb, loops of 1 kb are near the diagonal up to the 2 kb distance.
WITHOUT_2KB = {1000: 80_000}


def _split(loops: DataFrame, others: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Loops with one of the others within the radius, and those without."""
    near = reproducible(others, loops, radius).select(*COORDS)
    return loops.join(near, COORDS, "left_semi"), loops.join(near, COORDS, "left_anti")


def _sure(near: int, strong: float) -> Column:
    return (F.abs(F.col("start1") - F.col("start2")) < near) | (F.col("observed") > strong)


def _united(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates([*COORDS, "bin_size"])


def _confirmed(fine: DataFrame, coarse: list[tuple[DataFrame, int]], near: int, strong: float) -> DataFrame:
    """Fine loops that some coarser list has within twice its radius, or that need no confirmation."""
    return _united(fine.where(_sure(near, strong)), *(_split(fine, other, 2 * radius)[0] for other, radius in coarse))


def merge_resolutions(lists: dict[int, DataFrame], second: bool = False) -> DataFrame:
    """Loops (COORDS, observed) by bin size -> (COORDS, observed, bin_size): those that stay, each under the size it was called at.

    First generation: 5 and 10 kb, then what 25 kb has alone; other sizes count only where none of these is there, and are then
    put together as they are. Second generation: 1, 2 and 5 kb, as many as there are of them, then what 10 kb has alone.
    Loops of one place and size count once, with their smallest count; empty lists confirm nothing and take nothing away.
    """
    own = {size: stored(df.groupBy(*COORDS).agg(F.min("observed").alias("observed")).withColumn("bin_size", F.lit(size).cast("long"))) for size, df in lists.items()}
    if second:
        merged = _second({s: df for s, df in own.items() if s in (1000, 2000, 5000)})
        last, radius = own.get(10_000), 10_000
    elif not set(own) & {5000, 10_000, 25_000}:
        return _united(*own.values())
    else:
        merged = _pair(own[5000], own[10_000], 10_000, FIRST_NEAR[5000], FIRST_STRONG[5000]) if {5000, 10_000} <= set(own) else own.get(5000, own.get(10_000))
        last, radius = own.get(25_000), 25_000
    if last is None:
        return merged
    if merged is None:
        return last
    merged = stored(merged)
    return _united(merged, _split(last, merged, 2 * radius)[1])


def _pair(fine: DataFrame, coarse: DataFrame, radius: int, near: int, strong: float) -> DataFrame:
    return _united(_confirmed(fine, [(coarse, radius)], near, strong), _split(coarse, fine, 2 * radius)[1])


def _second(own: dict[int, DataFrame]) -> DataFrame | None:
    """1, 2 and 5 kb; a list that is there alone says nothing."""
    if len(own) < 2:
        return None
    if len(own) == 2:
        a, b = sorted(own)
        near = WITHOUT_2KB[1000] if (a, b) == (1000, 5000) else SECOND_NEAR[a]
        return _pair(own[a], own[b], b, near, SECOND_STRONG[a])
    one, two, five = own[1000], own[2000], own[5000]
    first = _confirmed(one, [(two, 2000), (five, 5000)], SECOND_NEAR[1000], SECOND_STRONG[1000])
    alone = stored(_split(two, one, 2 * 2000)[1])
    between = _confirmed(alone, [(five, 5000)], SECOND_NEAR[2000], SECOND_STRONG[2000])
    return _united(first, between, _split(_split(five, one, 2 * 5000)[1], two, 2 * 5000)[1])
