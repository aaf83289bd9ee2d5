"""The map store: Parquet folders by bin size and chromosome pair, rows sorted by bin_y and bin_x, with vectors beside them.

    cells/bin_size=10000/chr1=1/chr2=2/...
    vectors/norm=VC/bin_size=10000/...      expected/norm=VC/bin_size=10000/...

A query for one matrix opens one folder, and bounds on bins skip row groups of its files by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.operators import binning as B

#: Rows of bins that one task of a write takes, so that one matrix is as many tasks as it has bands; bytes of a row group.
BAND, ROW_GROUP = 2000, 16 << 20
CELLS = "bin_x long, bin_y long, counts double, bin_size long, chr1 long, chr2 long"
VECTORS = "chr long, bin long, value double, norm string, bin_size long"
EXPECTED = "dist long, value double, norm string, bin_size long"


def write_store(cells: DataFrame, path: str, mode: str = "overwrite", band: int = BAND) -> None:
    """Cells of any bin sizes and chromosome pairs; a band of a matrix is written by one task."""
    keys = ["bin_size", "chr1", "chr2"]
    dealt = cells.select(*B.KEYS, "counts").withColumn("band__", F.expr(f"bin_y div {band}"))
    dealt = dealt.repartition(*keys, "band__").sortWithinPartitions(*keys, "bin_y", "bin_x").drop("band__")
    dealt.write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy(*keys).parquet(f"{path}/cells")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELLS).parquet(f"{path}/cells").select(*B.KEYS, "counts")


def region_of_store(spark: SparkSession, path: str, bin_sizes: int | list[int], chr1: int, x1: int, x2: int, chr2: int, y1: int, y2: int) -> DataFrame:
    """Cells whose bin starts lie in a closed region, mirrored inside a chromosome; only their matrices' folders are listed.

    A branch for each bin size, so that every scan has plain bounds on bin_x and bin_y.
    """
    sizes = [bin_sizes] if isinstance(bin_sizes, int) else bin_sizes
    out = None
    for s in sizes:
        part = B.region(read_store(spark, path), chr1, x1, x2, chr2, y1, y2, s)
        out = part if out is None else out.unionByName(part)
    return out


def append_vectors(vectors: DataFrame, path: str, norm: str) -> None:
    """Adds vectors (bin_size, chr, bin, value) of a normalisation to the store."""
    rows = vectors.select(F.lit(norm).alias("norm"), "bin_size", "chr", "bin", "value")
    rows.repartition("bin_size", "chr").sortWithinPartitions("bin_size", "chr", "bin").write.mode("append").partitionBy("norm", "bin_size").parquet(f"{path}/vectors")


def read_vectors(spark: SparkSession, path: str, norm: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(f"{path}/vectors").where(F.col("norm") == norm).select("bin_size", "chr", "bin", "value")


def append_expected(expected: DataFrame, path: str, norm: str) -> None:
    """Adds an expectation (bin_size, dist, value) to the store."""
    rows = expected.select(F.lit(norm).alias("norm"), "bin_size", "dist", "value")
    rows.repartition("bin_size").sortWithinPartitions("bin_size", "dist").write.mode("append").partitionBy("norm", "bin_size").parquet(f"{path}/expected")


def read_expected(spark: SparkSession, path: str, norm: str) -> DataFrame:
    return spark.read.schema(EXPECTED).parquet(f"{path}/expected").where(F.col("norm") == norm).select("bin_size", "dist", "value")
