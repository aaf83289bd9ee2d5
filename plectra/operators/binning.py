"""Pairs to sparse contact matrices: chr1, chr2, bin_size, bin_x, bin_y, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.operators import pairs as P

KEYS = ("chr1", "chr2", "bin_size", "bin_x", "bin_y")


def _canonical(df: DataFrame) -> DataFrame:
    """Within a chromosome the smaller bin is bin_x."""
    intra = F.col("chr1") == F.col("chr2")
    return df.withColumns(
        {
            "bin_x": F.when(intra, F.least("x__", "y__")).otherwise(F.col("x__")),
            "bin_y": F.when(intra, F.greatest("x__", "y__")).otherwise(F.col("y__")),
        }
    ).drop("x__", "y__")


def binned(pairs: DataFrame, bin_size: int) -> DataFrame:
    """Pairs with their bins, flipped so that chr1 <= chr2; no shuffle."""
    out = P.flipped(pairs).withColumns(
        {"bin_size": F.lit(bin_size).cast("long"), "x__": F.expr(f"pos1 div {bin_size}"), "y__": F.expr(f"pos2 div {bin_size}")}
    )
    return _canonical(out)


def bin_contacts(pairs: DataFrame, bin_sizes: list[int]) -> DataFrame:
    """Summed scores at every bin size.

    Sizes that the smallest divides come from its cells, which are fewer than the pairs and are put out for all of them at
    once: the pairs are read and shuffled once, with partial sums; other sizes are summed from the pairs.
    """
    base = min(bin_sizes)
    factors = sorted({size // base for size in bin_sizes if size % base == 0})
    out = binned(pairs, base).groupBy(*KEYS).agg(F.sum("score").cast("double").alias("counts"))
    if len(factors) > 1:
        cells = out.withColumn("f__", F.explode(F.array(*(F.lit(f).cast("long") for f in factors))))
        coarse = {c: F.expr(f"{c} div f__") for c in ("bin_x", "bin_y")} | {"bin_size": F.col("bin_size") * F.col("f__")}
        out = cells.withColumns(coarse).groupBy(*KEYS).agg(F.sum("counts").alias("counts"))
    for size in sorted({s for s in bin_sizes if s % base}):
        out = out.unionByName(binned(pairs, size).groupBy(*KEYS).agg(F.sum("score").cast("double").alias("counts")))
    return out


def rebin(contacts: DataFrame, target: int) -> DataFrame:
    """Coarser cells, exactly; raises for targets that the cells' bin size does not divide."""
    ok = F.assert_true(F.lit(target) % F.col("bin_size") == 0, F.lit(f"{target} is no multiple of the bin size"))
    factor = F.expr(f"{target} div bin_size")
    coarse = contacts.where(ok.isNull()).withColumns({"f__": factor}).withColumns(
        {"bin_x": F.expr("bin_x div f__"), "bin_y": F.expr("bin_y div f__"), "bin_size": F.lit(target).cast("long")}
    )
    return coarse.groupBy(*KEYS).agg(F.sum("counts").alias("counts"))


def whole_genome_contacts(pairs: DataFrame, chroms: DataFrame, bins: int = 500) -> DataFrame:
    """All-by-all matrix of chromosome 0, about `bins` bins wide, in units of 1000 bases."""
    total = chroms.agg(F.sum("len").alias("n")).first().n  # one row a chromosome
    return bin_contacts(P.whole_genome(pairs, chroms), [max(1, total // 1000 // bins)])


def at_least(contacts: DataFrame, count: float) -> DataFrame:
    return contacts.where(F.col("counts") >= count)


def matrix_meta(contacts: DataFrame) -> DataFrame:
    """Per matrix: sum (cells off the diagonal of a chromosome count twice), cells, 5th and 95th percentile."""
    twice = (F.col("chr1") == F.col("chr2")) & (F.col("bin_x") != F.col("bin_y"))
    return contacts.groupBy("chr1", "chr2", "bin_size").agg(
        F.sum(F.when(twice, 2 * F.col("counts")).otherwise(F.col("counts"))).alias("sum_counts"),
        F.count("*").alias("cell_count"),
        F.percentile_approx("counts", 0.05, 10_000).alias("p05"),
        F.percentile_approx("counts", 0.95, 10_000).alias("p95"),
    )


def average_counts(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """Per matrix: sum over cells (off-diagonal ones twice) by the number of bin pairs."""
    meta = contacts.groupBy("chr1", "chr2", "bin_size").agg(
        F.sum(F.when((F.col("chr1") == F.col("chr2")) & (F.col("bin_x") != F.col("bin_y")), 2 * F.col("counts")).otherwise(F.col("counts"))).alias("s")
    )
    for i in (1, 2):
        meta = meta.join(F.broadcast(chroms.select(F.col("idx").alias(f"chr{i}"), F.col("len").alias(f"len{i}"))), f"chr{i}")
    bins = [F.expr(f"len{i} div bin_size").cast("double") for i in (1, 2)]
    return meta.select("chr1", "chr2", "bin_size", (F.col("s") / bins[0] / bins[1]).alias("average_count"))


def block_number(block_bins: int, block_columns: int):
    """Block of a cell: inside a chromosome by depth from the diagonal and place along it, else by row and column."""
    x, y = F.col("bin_x"), F.col("bin_y")
    depth = F.floor(F.log2(1 + F.abs(x - y) / F.sqrt(F.lit(2.0)) / block_bins)).cast("long")
    along = F.expr(f"((bin_x + bin_y) div 2) div {block_bins}")
    grid = F.expr(f"(bin_y div {block_bins}) * {block_columns} + bin_x div {block_bins}")
    return F.when(F.col("chr1") == F.col("chr2"), depth * block_columns + along).otherwise(grid)


def _bin_range(cells: DataFrame, column: str, low: int, high: int, sizes: list[int] | None) -> F.Column:
    """Whether a bin's start lies in a closed range, as bounds on the bare column for each bin size, which readers can use."""
    if sizes is None:
        return (F.col(column) * F.col("bin_size")).between(low, high)
    if len(sizes) == 1:
        return F.col(column).between(-(-low // sizes[0]), high // sizes[0])
    inside = F.lit(False)
    for s in sizes:
        inside = inside | ((F.col("bin_size") == s) & F.col(column).between(-(-low // s), high // s))
    # Bounds over all sizes stand beside the exact ones: they are what a scan without the sizes as folders can push down.
    return inside & F.col(column).between(min(-(-low // s) for s in sizes), max(high // s for s in sizes))


def region(cells: DataFrame, chr1: int, x1: int, x2: int, chr2: int, y1: int, y2: int, bin_sizes: int | list[int] | None = None) -> DataFrame:
    """Cells whose bin starts lie in the closed region; inside a chromosome a cell counts mirrored, too.

    A union of two ranges, each of which prunes files and row groups, rather than one OR over both columns. With the bin
    sizes given (one, or all that are wanted), the ranges are bounds on bin_x and bin_y themselves; without them they are
    on bin starts, which no reader can use. Cells of other bin sizes than those given are left out.
    """
    sizes = [bin_sizes] if isinstance(bin_sizes, int) else bin_sizes
    if sizes is not None:
        cells = cells.where(F.col("bin_size").isin(sizes))

    def part(a1, a2, b1, b2):
        inside = _bin_range(cells, "bin_x", a1, a2, sizes) & _bin_range(cells, "bin_y", b1, b2, sizes)
        return cells.where((F.col("chr1") == min(chr1, chr2)) & (F.col("chr2") == max(chr1, chr2)) & inside)

    if chr1 > chr2:
        x1, x2, y1, y2 = y1, y2, x1, x2
    direct = part(x1, x2, y1, y2)
    if chr1 != chr2 or (x1, x2) == (y1, y2):
        return direct
    start_x, start_y = F.col("bin_x") * F.col("bin_size"), F.col("bin_y") * F.col("bin_size")
    return direct.unionByName(part(y1, y2, x1, x2).where(~(start_x.between(x1, x2) & start_y.between(y1, y2))))


def sum_maps(maps: list[DataFrame]) -> DataFrame:
    """Cell-wise sum of several maps."""
    out = maps[0].select(*KEYS, "counts")
    for m in maps[1:]:
        out = out.unionByName(m.select(*KEYS, "counts"))
    return out.groupBy(*KEYS).agg(F.sum("counts").alias("counts"))


def mirrored(contacts: DataFrame) -> DataFrame:
    """Both triangles of the matrices inside a chromosome: (chr1, chr2, bin_size, i, j, counts)."""
    cells = F.array(F.struct(F.col("bin_x").alias("i"), F.col("bin_y").alias("j")), F.struct(F.col("bin_y").alias("i"), F.col("bin_x").alias("j")))
    one = F.array(F.struct(F.col("bin_x").alias("i"), F.col("bin_y").alias("j")))
    both = F.when((F.col("chr1") == F.col("chr2")) & (F.col("bin_x") != F.col("bin_y")), cells).otherwise(one)
    return contacts.select("chr1", "chr2", "bin_size", F.explode(both).alias("c"), "counts").select("chr1", "chr2", "bin_size", "c.i", "c.j", "counts")


def top_neighbors(contacts: DataFrame, k: int) -> DataFrame:
    """The k largest cells of every row of both triangles (ties: smaller partner bin first)."""
    from pyspark.sql import Window

    order = Window.partitionBy("chr1", "bin_size", "i").orderBy(F.desc("counts"), "j")
    rows = mirrored(contacts.where("chr1 = chr2")).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select(F.col("chr1").alias("chr"), "bin_size", "i", "j", "counts", F.col("rank").cast("long").alias("rank"))


def chromosome_pairs(chroms: DataFrame) -> DataFrame:
    """(chr1, chr2) of all chromosomes with chr1 <= chr2; the table holds one row a chromosome."""
    a, b = chroms.select(F.col("idx").alias("chr1")), chroms.select(F.col("idx").alias("chr2"))
    return a.crossJoin(F.broadcast(b)).where("chr1 <= chr2")


def validated(contacts: DataFrame, chroms: DataFrame, sizes: list[int], block: int) -> DataFrame:
    """(chr1, chr2, bin_size, cells, bad, first_block, good) of every chromosome pair and bin size that a map should hold.

    bad: cells without a positive count, below the diagonal, or behind a chromosome's end; first_block: cells of the
    first `block` bins of both axes. good: cells are there, none is bad, and the first block is not empty.
    """
    due = chromosome_pairs(chroms).withColumn("bin_size", F.explode(F.array(*(F.lit(x).cast("long") for x in sizes))))
    ends = [chroms.select(F.col("idx").alias(f"chr{k}"), F.col("len").alias(f"len{k}")) for k in (1, 2)]
    cells = contacts.join(F.broadcast(ends[0]), "chr1").join(F.broadcast(ends[1]), "chr2")
    bad = F.expr("counts <= 0 or isnan(counts) or (chr1 = chr2 and bin_x > bin_y) or bin_x * bin_size >= len1 or bin_y * bin_size >= len2")
    found = cells.groupBy("chr1", "chr2", "bin_size").agg(F.count("*").alias("cells"), F.count_if(bad).alias("bad"), F.count_if((F.col("bin_x") < block) & (F.col("bin_y") < block)).alias("first_block"))
    all_ = due.join(found, ["chr1", "chr2", "bin_size"], "left").na.fill(0, ["cells", "bad", "first_block"])
    return all_.withColumn("good", F.expr("cells > 0 and bad = 0 and first_block > 0"))
