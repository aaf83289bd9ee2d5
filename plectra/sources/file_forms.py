"""The files that maps, vectors, features and scaffolds are written as: rows (path, seq, content) for `raw_files.write_files`.

One matrix or list may be many files, each of the form in itself: bands of rows of a matrix, features of a chromosome pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectra.sources.matrix_files import CELL
from plectra.sources.pairs_binary import LONG

#: Rows of bins of one file.
BAND = 1000
#: The first columns of a feature file, and the attributes behind them in each of its layouts.
FEATURE = ["#chr1", "x1", "x2", "chr2", "y1", "y2", "name", "score", "strand1", "strand2", "color"]
LAYOUTS = {
    "enriched": ["observed", "expectedBL", "expectedDonut", "expectedH", "expectedV", "binBL", "binDonut", "binH", "binV", "fdrBL", "fdrDonut", "fdrH", "fdrV"],
    "final": ["observed", "expectedBL", "expectedDonut", "expectedH", "expectedV", "fdrBL", "fdrDonut", "fdrH", "fdrV", "numCollapsed", "centroid1", "centroid2", "radius"],
    "localized": ["highRes_start_1", "highRes_end_1", "highRes_start_2", "highRes_end_2", "localX", "localY", "localObserved", "localPval", "localPeakID"],
    "domains": ["score", "uVarScore", "lVarScore", "upSign", "loSign"],
}


def _line(*columns: str | Column) -> Column:
    return F.concat(F.concat_ws("\t", *columns), F.lit("\n"))


def _number(c: Column) -> Column:
    """Whole numbers without a fraction, others as Spark prints them."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def _matrix_path(ending: str, row: str, band: int) -> Column:
    return F.concat_ws("/", F.concat_ws("_", "chr1", "chr2", "bin_size"), F.concat(F.expr(f"{row} div {band}").cast("string"), F.lit(ending)))


def triples(cells: DataFrame, band: int = BAND) -> DataFrame:
    """Lines of both bins' starts and the count, a file a band of rows."""
    line = _line(*((F.col(c) * F.col("bin_size")).cast("string") for c in ("bin_x", "bin_y")), _number(F.col("counts")))
    return cells.select(_matrix_path(".txt", "bin_y", band).alias("path"), F.struct("bin_y", "bin_x").alias("seq"), line.alias("content"))


def dense_rows(cells: DataFrame, chroms: DataFrame, band: int = BAND) -> DataFrame:
    """Every row of the matrices inside chromosomes as a line of tab-separated counts, empty rows included; a row is a group."""
    from plectra.operators.binning import mirrored

    own = cells.where("chr1 = chr2").select("chr1", "chr2", "bin_size").distinct().join(F.broadcast(chroms.select(F.col("idx").alias("chr1"), "len")), "chr1")
    rows = own.withColumn("n", F.expr("(len - 1) div bin_size + 1")).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    held = mirrored(cells.where("chr1 = chr2")).groupBy("chr1", "chr2", "bin_size", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "counts"))).alias("held"))
    full = rows.join(held, ["chr1", "chr2", "bin_size", "i"], "left")
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: _number(F.coalesce(F.try_element_at("held", j), F.lit(0.0))))
    return full.select(_matrix_path(".txt", "i", band).alias("path"), F.col("i").alias("seq"), F.concat(F.array_join(numbers, "\t"), F.lit("\n")).alias("content"))


def _packed(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows (path, seq, fields of the record) with their record as content; of strands, forward is 0."""
    names = [n for n in kind.names if n != "pad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, kind)
            for k, n in enumerate(names, 2):
                values = batch.column(k).to_numpy(zero_copy_only=False)
                out[n] = np.where(values.astype(bool), 0, 1) if n.startswith("strand") else values
            data = out.tobytes()
            content = pa.array([data[k * kind.itemsize : (k + 1) * kind.itemsize] for k in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), content], names=["path", "seq", "content"])

    return rows.select("path", "seq", *names).mapInArrow(run, "path string, seq long, content binary")


def binary_cells(cells: DataFrame, band: int = BAND) -> DataFrame:
    """Twelve bytes a cell: bin_x, bin_y, counts, in row order; a file a band of rows."""
    order = (F.expr(f"bin_y % {band}") * (1 << 40) + F.col("bin_x")).alias("seq")
    return _packed(cells.select(_matrix_path(".bin", "bin_y", band).alias("path"), order, *CELL.names), CELL)


def binary_pairs(pairs: DataFrame, kind: np.dtype = LONG, files: int = 16) -> DataFrame:
    """Fixed-width pair records, dealt over so many files by position."""
    path = F.concat(F.lit("pairs-"), F.pmod(F.xxhash64("chr1", "pos1", "chr2", "pos2"), F.lit(files)).cast("string"), F.lit(".bin"))
    return _packed(pairs.withColumns({"path": path, "seq": F.col("pos1").cast("long")}), kind)


def npy_blocks(blocks: DataFrame) -> DataFrame:
    """(chr, block, content) of matrix_files.numpy_blocks as files <chr>/<block>.npy."""
    return blocks.select(F.concat(F.concat_ws("/", "chr", "block"), F.lit(".npy")).alias("path"), F.lit(0).alias("seq"), "content")


def lines_of(rows: DataFrame, path: Column, seq: str, value: str = "value") -> DataFrame:
    return rows.select(path.alias("path"), F.col(seq).alias("seq"), F.concat(F.col(value), F.lit("\n")).alias("content"))


def fixed_step(vectors: DataFrame) -> DataFrame:
    """Vectors (bin_size, chr, bin, value) as tracks: a header with start and step, then a value a line; bins between are 0.

    A file a chromosome and bin size, put out line by line; every run of neighbouring bins has a header of its own, so that
    bins without a value need no lines.
    """
    gap = F.col("bin") - F.coalesce(F.lag("bin").over(_by_bin()), F.lit(-2)) > 1
    head = F.concat(F.lit("fixedStep chrom="), "chr", F.lit(" start="), F.expr("bin * bin_size + 1"), F.lit(" step="), "bin_size", F.lit(" span="), "bin_size", F.lit("\n"))
    path = F.concat(F.concat_ws("_", "chr", "bin_size"), F.lit(".wig"))
    return vectors.withColumn("head", F.when(gap, head).otherwise("")).select(path.alias("path"), F.col("bin").alias("seq"), F.concat("head", F.col("value").cast("string"), F.lit("\n")).alias("content"))


def _by_bin():
    from pyspark.sql import Window

    # Windows of a band of bins; a band's first bin begins a run, which costs a header line and keeps windows short.
    return Window.partitionBy("bin_size", "chr", F.expr(f"bin div {100 * BAND}")).orderBy("bin")


def features(rows: DataFrame, layout: str | list[str]) -> DataFrame:
    """Features (chr1, start1, end1, chr2, start2, end2, color, attributes map) with a header line; a file a chromosome pair.

    The attributes behind the fixed columns are those of a layout by name, or the ones listed; missing ones are `null`.
    """
    keys = LAYOUTS[layout] if isinstance(layout, str) else layout
    path = F.concat(F.concat_ws("_", "chr1", "chr2"), F.lit(".bedpe"))
    dots = [F.lit(".")] * 4
    values = [F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("null")) for k in keys]
    fields = [F.col(c).cast("string") for c in ("chr1", "start1", "end1", "chr2", "start2", "end2")]
    order = [F.col(c).cast("long") for c in ("start1", "start2", "end1", "end2")]
    body = rows.select(path.alias("path"), F.struct(F.lit(1).alias("k"), F.array(*order).alias("a")).alias("seq"), _line(*fields, *dots, F.coalesce("color", F.lit("0,0,0")), *values).alias("content"))
    first = F.struct(F.lit(0).alias("k"), F.array(*[F.lit(0).cast("long")] * 4).alias("a"))
    return body.unionByName(rows.select(path.alias("path")).distinct().select("path", first.alias("seq"), _line(*map(F.lit, [*FEATURE, *keys])).alias("content")))


def bed(loci: DataFrame) -> DataFrame:
    """Loci (chr, x1, x2, name), a file a chromosome, by place."""
    return loci.select(F.concat(F.col("chr").cast("string"), F.lit(".bed")).alias("path"), F.struct("x1", "x2", "name").alias("seq"), _line(F.col("chr").cast("string"), F.col("x1").cast("string"), F.col("x2").cast("string"), "name").alias("content"))


def assembly(scaffolds: DataFrame, order: DataFrame, name: str = "map.assembly") -> DataFrame:
    """Scaffolds (name, id, length) and their order (grp, ord, signed_id): a line each scaffold, then a line each group; one file, as the form asks."""
    head = scaffolds.select(F.struct(F.lit(0).alias("k"), F.col("id").cast("long").alias("at")).alias("seq"), F.concat(F.lit(">"), F.concat_ws(" ", "name", F.col("id").cast("string"), F.col("length").cast("string")), F.lit("\n")).alias("content"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "signed_id"))), lambda s: s.getField("signed_id").cast("string"))
    groups = order.groupBy("grp").agg(F.array_join(listed, " ").alias("line"))
    tail = groups.select(F.struct(F.lit(1).alias("k"), F.col("grp").cast("long").alias("at")).alias("seq"), F.concat("line", F.lit("\n")).alias("content"))
    return head.unionByName(tail).withColumn("path", F.lit(name))
