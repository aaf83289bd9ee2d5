"""Matrices in binary records, numpy blocks and text: a cell, or a block of rows, at a time."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell as two little-endian integers and a float.
CELL = np.dtype([("bin_x", "<i4"), ("bin_y", "<i4"), ("counts", "<f4")])


def packed_cells(cells: DataFrame) -> DataFrame:
    """(content binary): twelve bytes a cell (bin_x, bin_y, counts), a row for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, CELL)
            for name in CELL.names:
                out[name] = batch.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["content"])

    return cells.select(*CELL.names).mapInArrow(run, "content binary")


def unpacked_cells(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (data for batch in batches for data in batch.column(0).to_pylist()):
            rows = np.frombuffer(data[: len(data) // CELL.itemsize * CELL.itemsize], CELL)
            kinds = {"bin_x": np.int64, "bin_y": np.int64, "counts": np.float64}
            yield pa.RecordBatch.from_pydict({n: pa.array(rows[n].astype(k)) for n, k in kinds.items()})

    return blobs.select("content").mapInArrow(run, "bin_x long, bin_y long, counts double")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every file of raw records below a path, one task a file."""
    return unpacked_cells(spark.read.format("binaryFile").load(path))


def _row_blocks(cells: DataFrame, height: int) -> DataFrame:
    return cells.withColumn("block", F.expr(f"i div {height}"))


def numpy_blocks(cells: DataFrame, height: int = 256) -> DataFrame:
    """(chr, block, content): `height` rows of a dense n x n matrix as one .npy array; from cells (chr, n, i, j, value).

    A group is one block of rows, never a whole matrix. Blocks without a cell are left out.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, block = int(rows["n"].iloc[0]), int(rows["block"].iloc[0])
        out = np.zeros((min(height, n - block * height), n))
        out[rows["i"].to_numpy() - block * height, rows["j"].to_numpy()] = rows["value"].to_numpy()
        held = io.BytesIO()
        np.save(held, out)
        return pd.DataFrame({"chr": [rows["chr"].iloc[0]], "block": [block], "content": [held.getvalue()]})

    return _row_blocks(cells, height).groupBy("chr", "block").applyInPandas(run, "chr long, block long, content binary")


def from_numpy_blocks(blocks: DataFrame, height: int = 256) -> DataFrame:
    """(chr, i, j, value) of the places that are not 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chr_, block, data in (row for frame in frames for row in frame.itertuples(index=False)):
            m = np.load(io.BytesIO(data), allow_pickle=False)
            i, j = np.nonzero(m)
            yield pd.DataFrame({"chr": chr_, "i": i + block * height, "j": j, "value": m[i, j]})

    return blocks.select("chr", "block", "content").mapInPandas(run, "chr long, i long, j long, value double")


def matrix_lines(cells: DataFrame) -> DataFrame:
    """(chr, i, value): the rows of dense n x n matrices as lines of blank-separated numbers; rows without a cell are left out.

    From cells (chr, n, i, j, value); a group is one row.
    """
    places = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    rows = cells.groupBy("chr", "i").agg(F.max("n").alias("n"), places.alias("m"))
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)).cast("string"))
    return rows.select("chr", "i", F.array_join(numbers, " ").alias("value"))


def parse_matrix_lines(lines: DataFrame) -> DataFrame:
    """(chr, i, j, value) of the places that are not 0; needs (chr, i, value) rows."""
    cells = lines.select("chr", "i", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "v"))
    return cells.select("chr", "i", F.col("j").cast("long").alias("j"), F.col("v").try_cast("double").alias("value")).where("value <> 0")
