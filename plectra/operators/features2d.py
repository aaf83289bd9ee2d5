"""Rectangles between two chromosomes: chr1, start1, end1, chr2, start2, end2, and attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDS = ["chr1", "start1", "end1", "chr2", "start2", "end2"]
CHRS = ["chr1", "chr2"]


def distinct(features: DataFrame) -> DataFrame:
    return features.dropDuplicates(COORDS)


def _other(b: DataFrame) -> DataFrame:
    return b.select(*(F.col(c).alias(c if c in CHRS else f"{c}__") for c in COORDS)).distinct()


def _cells(df: DataFrame, start: str, width: int, reach: int) -> DataFrame:
    """Rows by the cells of `width` that [start - reach, start + reach] touches."""
    first, last = F.expr(f"floor(({start} - {reach}) / {width})"), F.expr(f"floor(({start} + {reach}) / {width})")
    return df.withColumn("cell__", F.explode(F.sequence(first, last)))


def tolerant_join(a: DataFrame, b: DataFrame, tolerance: int, how: str, near: Column | None = None) -> DataFrame:
    """Semi or anti join of rectangles whose four coordinates differ by the tolerance at most.

    The second side is exploded into the cells that its start1 reaches, so the join is by (chr1, chr2, cell).
    """
    if near is None:
        near = reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"{c}__")) <= tolerance for c in COORDS if c not in CHRS))
    width = max(1, 4 * tolerance)
    left = a.withColumn("cell__", F.floor(F.col("start1") / width))
    right = _cells(_other(b), "start1__", width, tolerance)
    renamed = right.withColumnsRenamed({"cell__": "cell_b__", "chr1": "chr1_b__", "chr2": "chr2_b__"})
    cond = (F.col("cell__") == F.col("cell_b__")) & (F.col("chr1") == F.col("chr1_b__")) & (F.col("chr2") == F.col("chr2_b__")) & near
    return left.join(renamed, cond, how).drop("cell__")


def intersection(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """Distinct rectangles of a that b has within the tolerance."""
    if tolerance == 0:
        return distinct(a.join(b.select(*COORDS).distinct(), COORDS, "left_semi"))
    return distinct(tolerant_join(a, b, tolerance, "left_semi"))


def subtract(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """Distinct rectangles of a that b lacks within the tolerance."""
    if tolerance == 0:
        return distinct(a.join(b.select(*COORDS).distinct(), COORDS, "left_anti"))
    return distinct(tolerant_join(a, b, tolerance, "left_anti"))


def symmetric_difference(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """What one list has and the other lacks, with the list's name in parent_list."""
    left = subtract(a, b, tolerance).select(*COORDS, F.lit("A").alias("parent_list"))
    return left.unionByName(subtract(b, a, tolerance).select(*COORDS, F.lit("B").alias("parent_list")))


def _mid(c: str, tail: str = "") -> Column:
    return F.expr(f"(start{c}{tail} + end{c}{tail}) div 2")


def _overlaps() -> Column:
    """The mid-point of the left rectangle lies in the right one, widened by half its width on each side."""
    parts = []
    for i in ("1", "2"):
        half = F.expr(f"(end{i}__ - start{i}__) div 2")
        parts.append((_mid(i) >= F.col(f"start{i}__") - half) & (_mid(i) <= F.col(f"end{i}__") + half))
    return parts[0] & parts[1]


def _box_join(a: DataFrame, b: DataFrame, how: str, width: int = 10_000) -> DataFrame:
    """Semi or anti join by _overlaps, over cells of the first axis."""
    left = a.withColumn("cell__", _mid("1").cast("long") - F.pmod(_mid("1"), F.lit(width)))
    half = F.expr("(end1__ - start1__) div 2")
    first, last = F.floor((F.col("start1__") - half) / width) * width, F.floor((F.col("end1__") + half) / width) * width
    right = _other(b).withColumn("cell_b__", F.explode(F.sequence(first, last, F.lit(width).cast("long"))))
    right = right.withColumnsRenamed({"chr1": "chr1_b__", "chr2": "chr2_b__"})
    same = (F.col("cell__") == F.col("cell_b__")) & (F.col("chr1") == F.col("chr1_b__")) & (F.col("chr2") == F.col("chr2_b__"))
    return left.join(right, same & _overlaps(), how).drop("cell__")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rectangles of a that overlap any of b."""
    return distinct(_box_join(a, b, "left_semi"))


def add_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, and those of b that overlap none of a."""
    extra = distinct(_box_join(b, a, "left_anti"))
    return distinct(a).select(*COORDS).unionByName(extra.select(*COORDS))


def reproducible(a: DataFrame, b: DataFrame, radius: int, fraction: float | None = None) -> DataFrame:
    """Distinct rectangles of b with a rectangle of a whose starts lie within the radius (Euclidean).

    With a fraction, the nearest one's distance must also be that part at most of start2 - start1.
    """
    width = max(1, 2 * radius)
    left = b.select(*COORDS).distinct().withColumn("cell__", F.floor(F.col("start1") / width))
    right = _cells(_other(a), "start1__", width, radius).withColumnsRenamed({"cell__": "cell_b__", "chr1": "chr1_b__", "chr2": "chr2_b__"})
    d2 = F.pow((F.col("start1") - F.col("start1__")).cast("double"), F.lit(2.0)) + F.pow((F.col("start2") - F.col("start2__")).cast("double"), F.lit(2.0))
    same = (F.col("cell__") == F.col("cell_b__")) & (F.col("chr1") == F.col("chr1_b__")) & (F.col("chr2") == F.col("chr2_b__")) & (d2 <= float(radius) ** 2)
    if fraction is None:
        return left.join(right, same, "left_semi").drop("cell__")
    near = left.join(right, same).withColumn("d__", F.sqrt(d2)).groupBy(*COORDS).agg(F.min("d__").alias("d"))
    return near.where(F.col("d") <= fraction * (F.col("start2") - F.col("start1"))).drop("d")


def near_centroids(a: DataFrame, centroids: DataFrame, keep: bool = True) -> DataFrame:
    """Rectangles whose (start1, start2) is (or is not) a centroid."""
    keys = ["chr1", "chr2", "start1", "start2"]
    return a.join(centroids.select(*keys).distinct(), keys, "left_semi" if keep else "left_anti")


def loop_domains(domains: DataFrame, loops: DataFrame, tolerance: int) -> DataFrame:
    """Distinct domains with a loop at their corner: its mid-point in the domain's corner box widened, and not narrowed, by the tolerance."""
    width = max(1, 4 * tolerance)
    d = distinct(domains).withColumn("cell__", F.floor(F.col("start1") / width))
    loop = loops.select(F.col("chr1").alias("chr1_b__"), F.col("chr2").alias("chr2_b__"), _mid("1").alias("m1"), _mid("2").alias("m2")).distinct()
    loop = loop.withColumn("cell_b__", F.explode(F.sequence(F.floor((F.col("m1") - tolerance) / width), F.floor((F.col("m1") + tolerance) / width))))
    hit = (F.abs(F.col("m1") - F.col("start1")) <= tolerance) & (F.abs(F.col("m2") - F.col("end1")) <= tolerance)
    same = (F.col("cell__") == F.col("cell_b__")) & (F.col("chr1") == F.col("chr1_b__")) & (F.col("chr2") == F.col("chr2_b__"))
    return d.join(loop, same & hit, "left_semi").drop("cell__")


def compare_lists(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Both lists in five classes: common (exact), A or B within the tolerance, A* or B* unique."""
    common = intersection(a, b).select(*COORDS, F.lit("common").alias("class"))
    out = common
    for name, own, other in (("A", a, b), ("B", b, a)):
        rest = subtract(own, other)
        close = intersection(rest, other, tolerance).select(*COORDS, F.lit(name).alias("class"))
        alone = subtract(rest, other, tolerance).select(*COORDS, F.lit(f"{name}*").alias("class"))
        out = out.unionByName(close).unionByName(alone)
    return out


def intersect_all(lists: list[DataFrame], tolerance: int = 10_000) -> DataFrame:
    return reduce(lambda x, y: intersection(x, y, tolerance), lists)


def window_hits(features: DataFrame, chr1: int, x1: int, x2: int, chr2: int, y1: int, y2: int, inside: bool = False) -> DataFrame:
    """Rectangles that a window meets, or holds."""
    own = features.where((F.col("chr1") == chr1) & (F.col("chr2") == chr2))
    if inside:
        return own.where((F.col("start1") >= x1) & (F.col("end1") <= x2) & (F.col("start2") >= y1) & (F.col("end2") <= y2))
    return own.where((F.col("start1") <= x2) & (F.col("end1") >= x1) & (F.col("start2") <= y2) & (F.col("end2") >= y1))


def nearest(features: DataFrame, chr1: int, chr2: int, x: int, y: int, n: int) -> DataFrame:
    """The n rectangles nearest to a point (distance to the rectangle, ties by coordinates): a top-k report."""
    dx = F.greatest(F.col("start1") - x, F.lit(0), x - F.col("end1")).cast("double")
    dy = F.greatest(F.col("start2") - y, F.lit(0), y - F.col("end2")).cast("double")
    own = distinct(features.where((F.col("chr1") == chr1) & (F.col("chr2") == chr2)))
    return own.select(*COORDS, F.sqrt(dx * dx + dy * dy).alias("distance")).orderBy("distance", *COORDS).limit(n)


def in_size_band(features: DataFrame, res: int, least: int, most: int) -> DataFrame:
    """Mid-points `least` to `most` bins apart."""
    d = F.abs(_mid("1") - _mid("2")).cast("double") / res
    return features.where(F.floor(d + 0.5).between(least, most))


def off_diagonal(features: DataFrame, least: int) -> DataFrame:
    return features.where(F.abs(F.col("start1") - F.col("start2")) >= least)


def convergence(features: DataFrame) -> DataFrame:
    """Counts by motif orientation of both anchors: strand1, strand2 booleans, unique1, unique2 booleans (null: no motif)."""
    status = (
        F.when(F.col("strand1").isNull() | F.col("strand2").isNull(), "incomplete")
        .when(~(F.col("unique1") & F.col("unique2")), "non-unique")
        .otherwise(F.concat(F.when(F.col("strand1"), "+").otherwise("-"), F.when(F.col("strand2"), "+").otherwise("-")))
    )
    return features.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
