"""Fixed-width little-endian pair records: 26 bytes (with score and chromosome indexes as below) or 20 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Strand byte, chromosome, position and fragment of each end; the long form ends with a float score.
SHORT = np.dtype([("strand1", "i1"), ("chr1", "<i4"), ("pos1", "<i4"), ("strand2", "i1"), ("chr2", "<i4"), ("pos2", "<i4"), ("pad", "V2")])
LONG = np.dtype([("strand1", "i1"), ("chr1", "<i4"), ("pos1", "<i4"), ("frag1", "<i4"), ("strand2", "i1"), ("chr2", "<i4"), ("pos2", "<i4"), ("frag2", "<i4")])


def _records(data: bytes, kind: np.dtype) -> pa.RecordBatch:
    rows = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind)
    strands = {f"strand{i}": pa.array(rows[f"strand{i}"] == 0) for i in (1, 2)}
    rest = {n: pa.array(rows[n].astype(np.int64)) for n in kind.names if n[:3] in ("chr", "pos", "fra")}
    return pa.RecordBatch.from_pydict(strands | rest)


def _schema(kind: np.dtype) -> str:
    rest = ", ".join(f"{n} long" for n in kind.names if n[:3] in ("chr", "pos", "fra"))
    return f"strand1 boolean, strand2 boolean, {rest}"


def read_binary_pairs(spark: SparkSession, path: str, kind: np.dtype = LONG) -> DataFrame:
    """Every file of a path, one task a file; large inputs should come as several files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _records(data, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _schema(kind))


def packed(pairs: DataFrame, kind: np.dtype = LONG) -> DataFrame:
    """(content binary): the records of each Arrow batch, ready for a writer of binary columns."""
    names = [n for n in kind.names if n != "pad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, kind)
            for n in names:
                values = batch.column(n).to_numpy(zero_copy_only=False)
                out[n] = np.where(values.astype(bool), 0, 1) if n.startswith("strand") else values
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["content"])

    return pairs.select(*names).mapInArrow(run, "content binary")


def unpacked(blobs: DataFrame, kind: np.dtype = LONG) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _records(data, kind)

    return blobs.select("content").mapInArrow(run, _schema(kind))
