"""One-dimensional closed intervals: chr, x1, x2."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectra.operators import scans as S
from plectra.plans.storage import stored

#: Bits of the shortest bucket of the overlap join, about the length of usual intervals.
LEAST_BITS = 11


def _level(x1: str, x2: str) -> Column:
    """Bits of the shortest bucket that is as long as an interval, so that it touches two of them at most."""
    return F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.greatest(F.lit(1), F.expr(f"{x2} - {x1} + 1")).cast("double")))).cast("int")


def _levels(df: DataFrame, x1: str, x2: str) -> list[int]:
    """The levels that intervals of a table have, some fifty at most."""
    return sorted(r.l for r in df.select(_level(x1, x2).alias("l")).distinct().collect() if r.l is not None)


def overlap_join(a: DataFrame, b: DataFrame, own: tuple[str, str] = ("x1", "x2"), other: tuple[str, str] = ("y1", "y2")) -> DataFrame:
    """Rows of a and b on one chromosome whose closed intervals overlap, without a product of the two.

    Buckets come in levels of powers of two. A pair meets at the level of its longer interval, where each of the two
    touches two buckets at most; it is kept only in the bucket where the later of them begins, so it appears once. Rows are put
    out again for each longer level that the other side has, which are few. Hot buckets are split by AQE.
    """
    (a1, a2), (b1, b2) = own, other
    levels = _levels(a, a1, a2), _levels(b, b1, b2)

    def side(df: DataFrame, x1: str, x2: str, at: list[int] | None, above: bool) -> DataFrame:
        """Rows by bucket: at their own level, or at those of `at` that are not shorter (or longer) than it."""
        ranked = df.withColumn("l__", _level(x1, x2))
        if at is not None:
            wanted = F.filter(F.array(*map(F.lit, at)), lambda v: v > F.col("l__") if above else v >= F.col("l__"))
            ranked = ranked.withColumn("l__", F.explode(wanted))
        first, last = (F.expr(f"shiftright(cast({x} as long), l__)") for x in (x1, x2))
        return ranked.withColumn("bucket__", F.explode(F.sequence(first, last)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        begins = F.expr(f"shiftright(cast(greatest({a1}, {b1}) as long), l__)")
        hit = left.join(right, ["chr", "l__", "bucket__"]).where((F.col(a1) <= F.col(b2)) & (F.col(b1) <= F.col(a2)) & (F.col("bucket__") == begins))
        return hit.drop("l__", "bucket__")

    out = met(side(a, a1, a2, levels[1], False), side(b, b1, b2, None, False))
    if any(x > y for x in levels[0] for y in levels[1]):
        out = out.unionByName(met(side(a, a1, a2, None, False), side(b, b1, b2, levels[0], True)))
    return out


def islands(loci: DataFrame) -> DataFrame:
    """Distinct intervals with the number of their island: a new one starts where x1 is past every earlier end."""
    rows = S.ranged(loci.select("chr", "x1", "x2").where("x1 is not null and x2 is not null").distinct(), ["chr"], ["x1", "x2"])
    ends = S.prefix(rows, ["chr"], "end__", "max", F.col("x2"), False)
    fresh = F.when(F.col("end__").isNull() | (F.col("x1") > F.col("end__")), 1).otherwise(0)
    return S.prefix(ends, ["chr"], "island__", "sum", fresh, True).select("chr", "x1", "x2", "island__")


def merge(loci: DataFrame) -> DataFrame:
    """Overlapping intervals fused."""
    return islands(loci).groupBy("chr", "island__").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("island__")


def merge_keep_smaller(loci: DataFrame) -> DataFrame:
    """Like merge, but of a contained pair the inner interval stays; the state runs along each island of overlapping intervals.

    An interval past every earlier end is past the state's, too, so islands are independent groups.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for x1, x2 in sorted(set(zip(rows["x1"], rows["x2"], strict=True))):
            if out and x1 <= out[-1][1]:
                a1, a2 = out[-1]
                if a1 <= x1 and x2 <= a2:
                    out[-1] = [x1, x2]
                elif x1 <= a1 and a2 <= x2:
                    pass
                else:
                    out[-1] = [min(a1, x1), max(a2, x2)]
            else:
                out.append([x1, x2])
        return pd.DataFrame([(rows["chr"].iloc[0], *x) for x in out], columns=["chr", "x1", "x2"])

    return islands(loci).groupBy("chr", "island__").applyInPandas(run, "chr long, x1 long, x2 long")


def expand_small(loci: DataFrame, least: int) -> DataFrame:
    """Intervals shorter than `least` widened by half the deficit on both sides, then merged."""
    half = F.expr(f"greatest(0L, {least} - (x2 - x1)) div 2")
    wide = loci.select("chr", (F.col("x1") - half).alias("x1"), (F.col("x2") + half).alias("x2"))
    return merge(wide)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct overlaps (chr, max start, min end) of intervals with x1 <= x2, without the pairs that make them.

    An overlap that begins with one list's start s and ends with the other's end e needs the furthest end at s and the
    earliest start at e alone; one that is a whole interval needs the furthest end of the other list's starts up to s. So each
    place is put out once, however many pairs have it.
    """
    own = {"a": a.select("chr", F.col("x1").alias("s"), F.col("x2").alias("e")), "b": b.select("chr", F.col("x1").alias("s"), F.col("x2").alias("e"))}
    own = {k: stored(df.where("chr is not null and s is not null and e is not null").distinct()) for k, df in own.items()}
    both = own["a"].withColumn("in_a", F.lit(True)).unionByName(own["b"].withColumn("in_a", F.lit(False)))
    starts = both.groupBy("chr", "s").agg(F.max(F.expr("if(in_a, e, null)")).alias("end_a"), F.max(F.expr("if(in_a, null, e)")).alias("end_b"))
    starts = S.ranged(starts, ["chr"], ["s"])
    for k in own:
        starts = S.prefix(starts, ["chr"], f"furthest_{k}", "max", F.col(f"end_{k}"), True)
    starts = stored(starts.drop("part__", "at__"))
    ends = stored(both.groupBy("chr", "e").agg(F.min(F.expr("if(in_a, s, null)")).alias("start_a"), F.min(F.expr("if(in_a, null, s)")).alias("start_b")))
    reach = starts.select("chr", "s", F.greatest("end_a", "end_b").alias("r"), "end_a", "end_b")
    met = overlap_join(reach, ends.withColumn("e2", F.col("e")), ("s", "r"), ("e", "e2"))
    out = met.where("(end_a >= e and start_b <= s) or (end_b >= e and start_a <= s)").select("chr", F.col("s").alias("x1"), F.col("e").alias("x2"))
    for k, other in (("a", "b"), ("b", "a")):
        whole = own[k].join(starts, ["chr", "s"]).join(ends, ["chr", "e"]).where(f"furthest_{other} >= e")
        new = whole.where(f"not coalesce(end_{other} >= e, false) and not coalesce(start_{other} <= s, false)")
        out = out.unionByName(new.select("chr", F.col("s").alias("x1"), F.col("e").alias("x2")))
    return out


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chr, x1, x2): the stretches of bases that both lists cover. Merged lists have no more overlaps than intervals."""
    hit = overlap_join(stored(merge(a)), stored(merge(b)).withColumnsRenamed({"x1": "y1", "x2": "y2"}))
    return hit.select("chr", F.greatest("x1", "y1").alias("x1"), F.least("x2", "y2").alias("x2"))


def _touching(rows: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows (chr, x1, x2, ...) that overlap any of b; b is merged first, so it adds few rows."""
    other = stored(merge(b)).select("chr", F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    return overlap_join(rows.distinct(), other).select(*rows.columns).distinct()


def keep_intersecting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct intervals of a that overlap any of b, unchanged."""
    return _touching(a.select("chr", "x1", "x2"), b)


def counted(base: DataFrame, motifs: DataFrame) -> DataFrame:
    """(chr, b1, b2, n): distinct base loci with how many motifs overlap them.

    Those are the motifs that begin up to b2 without those that end before b1, so two running counts do without the pairs.
    """
    loci = base.select("chr", F.col("x1").alias("b1"), F.col("x2").alias("b2")).where("b1 is not null and b2 is not null").distinct()

    def places(df: DataFrame, first: Column, last: Column) -> DataFrame:
        both = F.array(F.struct(F.lit(True).alias("begins"), first.alias("at")), F.struct(F.lit(False).alias("begins"), last.alias("at")))
        return df.select("chr", F.explode(both).alias("p")).groupBy("chr", "p.begins", "p.at").agg(F.count("*").alias("n"))

    seen = places(motifs.where("x1 is not null and x2 is not null"), F.col("x1"), F.col("x2")).withColumn("asks", F.lit(False))
    asked = places(loci, F.col("b2"), F.col("b1") - 1).withColumns({"n": F.lit(0).cast("long"), "asks": F.lit(True)})
    running = stored(S.cumulative(seen.unionByName(asked), ["chr", "begins"], ["at", "asks"], "sum__", F.col("n")).where("asks"))
    begun = running.where("begins").select("chr", F.col("at").alias("b2"), F.col("sum__").alias("begun"))
    ended = running.where("not begins").select("chr", (F.col("at") + 1).alias("b1"), F.col("sum__").alias("ended"))
    return loci.join(begun, ["chr", "b2"]).join(ended, ["chr", "b1"]).select("chr", "b1", "b2", F.expr("begun - ended").alias("n"))


def _at_counted(base: DataFrame, motifs: DataFrame, which: str) -> DataFrame:
    loci = stored(counted(base, motifs).where(which)).select("chr", F.col("b1").alias("x1"), F.col("b2").alias("x2"))
    return _touching(motifs.select("chr", "x1", "x2", "score"), loci)


def retain_unique(base: DataFrame, motifs: DataFrame) -> DataFrame:
    """Motifs that are the only one at a base locus."""
    return _at_counted(base, motifs, "n = 1")


def retain_multi(base: DataFrame, motifs: DataFrame) -> DataFrame:
    """Motifs at a base locus with several."""
    return _at_counted(base, motifs, "n > 1")


def _blocks(df: DataFrame, x1: str, x2: str) -> DataFrame:
    """Rows by the aligned blocks of 2^l__ bases, numbered block__, that make up a closed interval: two a level at most."""
    levels = df.withColumn("l__", F.explode(F.sequence(F.lit(0), F.ceil(F.log2((F.col(x2) - F.col(x1) + 1).cast("double"))).cast("int"))))
    low, high = F.expr(f"-shiftright(-cast({x1} as long), l__)"), F.expr(f"shiftright(cast({x2} as long) + 1, l__)")
    pieces = F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1))
    return levels.where(low < high).withColumn("block__", F.explode(pieces)).where("block__ is not null")


def _levels_of(df: DataFrame, x: str, last: int) -> DataFrame:
    """Rows by the block of each level up to `last` that holds x."""
    return df.withColumn("l__", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("block__", F.expr(f"shiftright(cast({x} as long), l__)"))


def _last_level(df: DataFrame, x1: str, x2: str) -> int:
    longest = df.agg(F.max(F.expr(f"{x2} - {x1} + 1")).alias("n")).first().n
    return max(1, longest or 1).bit_length()


def best_overlapping(base: DataFrame, motifs: DataFrame) -> DataFrame:
    """(chr, b1, b2) of distinct base loci with the columns of their best motif (ties: smaller start, then end, then larger other columns).

    Motifs are numbered by rank. One that overlaps a locus begins in it or holds its first base: the highest rank of those
    that begin in each aligned block answers for the blocks of a locus, the highest rank of those that have a block among
    their own answers for the blocks around its first base. Rows grow with the levels of lengths, not with the pairs.
    """
    more = [c for c in motifs.columns if c not in ("chr", "x1", "x2", "score")]
    loci = stored(base.select("chr", F.col("x1").alias("b1"), F.col("x2").alias("b2")).where("b1 <= b2").distinct())
    ranked = S.ranged(motifs.where("x1 <= x2").groupBy("chr", "x1", "x2", *more).agg(F.max("score").alias("score")), [], ["score", -F.col("x1"), -F.col("x2"), *more])
    top = F.max("at__").alias("at__")
    begin = _levels_of(ranked.groupBy("chr", "x1").agg(top), "x1", _last_level(loci, "b1", "b2"))
    hold = _blocks(ranked.groupBy("chr", "x1", "x2").agg(top), "x1", "x2")
    keys = ["chr", "begins", "l__", "block__"]
    tops = begin.withColumn("begins", F.lit(True)).select(*keys, "at__").unionByName(hold.withColumn("begins", F.lit(False)).select(*keys, "at__")).groupBy(*keys).agg(top)
    inside = _blocks(loci, "b1", "b2").withColumn("begins", F.lit(True))
    around = _levels_of(loci, "b1", _last_level(ranked, "x1", "x2")).withColumn("begins", F.lit(False))
    best = inside.unionByName(around.select(*inside.columns)).join(tops, keys).groupBy("chr", "b1", "b2").agg(top)
    return best.join(ranked.select("at__", "x1", "x2", "score", *more), "at__").select("chr", "b1", "b2", "x1", "x2", "score", *more)


def retain_best(base: DataFrame, motifs: DataFrame) -> DataFrame:
    """The best motif of each base locus (ties: smaller start, then end)."""
    return best_overlapping(base, motifs.select("chr", "x1", "x2", "score")).select("chr", "x1", "x2", "score").distinct()


def unique_in_bin(motifs: DataFrame, size: int) -> DataFrame:
    """Motifs alone in their (x1 div size, x2 div size) cell."""
    alone = Window.partitionBy("chr", F.expr(f"x1 div {size}"), F.expr(f"x2 div {size}"))
    return motifs.withColumn("n__", F.count("*").over(alone)).where("n__ = 1").drop("n__")


def best_in_bin(motifs: DataFrame, size: int) -> DataFrame:
    """The best-scoring motif of each (x1 div size, x2 div size) cell; ties: smaller start, then end."""
    order = F.struct("score", (-F.col("x1")).alias("o1"), (-F.col("x2")).alias("o2"), "x1", "x2")
    best = motifs.groupBy("chr", F.expr(f"x1 div {size}").alias("k1"), F.expr(f"x2 div {size}").alias("k2")).agg(F.max(order).alias("m"))
    return best.select("chr", "m.x1", "m.x2", "m.score")


def covering(points: DataFrame, regions: DataFrame, at: Column) -> DataFrame:
    """Points (chr, ...) with the region (r1, r2) that covers `at`."""
    p = points.withColumns({"p1__": at, "p2__": at})
    r = regions.select("chr", F.col("x1").alias("r1"), F.col("x2").alias("r2"))
    return overlap_join(p, r, ("p1__", "p2__"), ("r1", "r2")).drop("p1__", "p2__")
