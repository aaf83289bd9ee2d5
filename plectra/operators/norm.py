"""Normalisation: coverage vectors, sparse matrix times vector, the genome as one matrix.

Vectors are rows (bin_size, chr, bin, value). A cell's normalised count is counts / (v[x] * v[y]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div
from plectra.operators.binning import mirrored


def row_sums(contacts: DataFrame) -> DataFrame:
    """Coverage of each bin over both triangles of its chromosome's matrix."""
    rows = mirrored(contacts.where("chr1 = chr2"))
    return rows.groupBy("bin_size", F.col("chr1").alias("chr"), F.col("i").alias("bin")).agg(F.sum("counts").alias("value"))


def nonzero_rows(contacts: DataFrame) -> DataFrame:
    """Cells of each row over both triangles."""
    rows = mirrored(contacts.where("chr1 = chr2 and counts <> 0"))
    return rows.groupBy("bin_size", F.col("chr1").alias("chr"), F.col("i").alias("bin")).agg(F.count("*").alias("cells"))


def normalize(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts over both bins' vector values; cells whose result is NaN (or without a value) go.

    Vectors are as long as the chromosomes have bins; Spark broadcasts them where they are small, and joins by
    hash otherwise.
    """
    v1 = vectors.select("bin_size", F.col("chr").alias("chr1"), F.col("bin").alias("bin_x"), F.col("value").alias("v1__"))
    v2 = vectors.select("bin_size", F.col("chr").alias("chr2"), F.col("bin").alias("bin_y"), F.col("value").alias("v2__"))
    both = contacts.join(v1, ["bin_size", "chr1", "bin_x"]).join(v2, ["bin_size", "chr2", "bin_y"])
    value = ieee_div("counts", F.col("v1__") * F.col("v2__"))
    return both.withColumn("counts", value).where(~F.isnan("counts")).select(*contacts.columns)


def sum_factors(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(bin_size, chr, factor): sqrt of the normalised over the raw total, both triangles, over valid cells."""
    intra = contacts.where("chr1 = chr2")
    valid = normalize(intra.withColumn("raw__", F.col("counts")), vectors)
    twice = F.when(F.col("bin_x") != F.col("bin_y"), 2.0).otherwise(1.0)
    sums = valid.groupBy("bin_size", F.col("chr1").alias("chr")).agg(F.sum(twice * F.col("counts")).alias("n"), F.sum(twice * F.col("raw__")).alias("r"))
    return sums.select("bin_size", "chr", F.sqrt(ieee_div("n", "r")).alias("factor"))


def rescaled(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors scaled so that the normalised total equals the raw one."""
    factors = F.broadcast(sum_factors(contacts, vectors))
    return vectors.join(factors, ["bin_size", "chr"]).select("bin_size", "chr", "bin", (F.col("value") * F.col("factor")).alias("value"))


def vanilla_coverage(contacts: DataFrame, root: bool = False) -> DataFrame:
    """Row sums (or their square roots), rescaled."""
    sums = row_sums(contacts)
    return rescaled(contacts, sums.withColumn("value", F.sqrt("value")) if root else sums)


def spmv(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """y = A v on upper triangles: each cell adds to its row, and off the diagonal to its column, too."""
    cells = contacts.where("chr1 = chr2").select("bin_size", F.col("chr1").alias("chr"), "bin_x", "bin_y", "counts")
    return _spmv(cells, vectors)


def _spmv(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    both = F.when(
        F.col("bin_x") == F.col("bin_y"), F.array(F.struct(F.col("bin_x").alias("bin"), F.col("bin_y").alias("at")))
    ).otherwise(
        F.array(
            F.struct(F.col("bin_x").alias("bin"), F.col("bin_y").alias("at")),
            F.struct(F.col("bin_y").alias("bin"), F.col("bin_x").alias("at")),
        )
    )
    terms = cells.select("bin_size", "chr", F.explode(both).alias("c"), "counts").select("bin_size", "chr", "c.bin", "c.at", "counts")
    values = vectors.select("bin_size", "chr", F.col("bin").alias("at"), F.col("value").alias("v__"))
    return terms.join(values, ["bin_size", "chr", "at"]).groupBy("bin_size", "chr", "bin").agg(F.sum(F.col("counts") * F.col("v__")).alias("value"))


def offset_contacts(contacts: DataFrame, chroms: DataFrame, between_only: bool = False) -> DataFrame:
    """The genome as one chromosome 0: bins of all chromosomes one after the other; optionally without cells inside one."""
    from pyspark.sql import Window

    sizes = contacts.select("bin_size").distinct().crossJoin(F.broadcast(chroms)).withColumn("n", F.expr("len div bin_size + 1"))
    before = Window.partitionBy("bin_size").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bin_size", "idx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    out = contacts.where("chr1 <> chr2") if between_only else contacts
    for i, b in ((1, "bin_x"), (2, "bin_y")):
        own = F.broadcast(offsets.select("bin_size", F.col("idx").alias(f"chr{i}"), F.col("o").alias("o__")))
        out = out.join(own, ["bin_size", f"chr{i}"]).withColumn(b, F.col(b) + F.col("o__")).drop("o__")
    return out.withColumns({"chr1": F.lit(0).cast("long"), "chr2": F.lit(0).cast("long")}).select(*contacts.columns)


def split_vector(vector: DataFrame, chroms: DataFrame) -> DataFrame:
    """A vector of the one chromosome 0 back to its chromosomes."""
    from pyspark.sql import Window

    sizes = vector.select("bin_size").distinct().crossJoin(F.broadcast(chroms)).withColumn("n", F.expr("len div bin_size + 1"))
    before = Window.partitionBy("bin_size").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("bin_size", "idx", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o")))
    inside = (F.col("bin") >= F.col("o")) & (F.col("bin") < F.col("o") + F.col("n"))
    return vector.join(offsets, "bin_size").where(inside).select("bin_size", F.col("idx").alias("chr"), (F.col("bin") - F.col("o")).alias("bin"), "value")


def matrix_sums(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(bin_size, chr, norm_sum, raw_sum, valid_cells) of cells with a valid normalised value."""
    valid = normalize(contacts.where("chr1 = chr2").withColumn("raw__", F.col("counts")), vectors)
    return valid.groupBy("bin_size", F.col("chr1").alias("chr")).agg(
        F.sum("counts").alias("norm_sum"), F.sum("raw__").alias("raw_sum"), F.count("*").alias("valid_cells")
    )


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two vectors side by side, full outer on bin, with their ratio."""
    left = a.select("bin_size", "chr", "bin", F.col("value").alias("a"))
    right = b.select("bin_size", "chr", "bin", F.col("value").alias("b"))
    return left.join(right, ["bin_size", "chr", "bin"], "full").withColumn("ratio", ieee_div("a", "b"))
