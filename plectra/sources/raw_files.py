"""Files of given bytes, written by tasks, and files of fixed-width records, read in ranges.

Writing takes rows (path, seq, content): a file is the contents of its path in order of seq, put out by one task as the rows
stream by. Tasks write into a folder of the job's own; commit moves the files of the tasks that count, so a retried task
leaves one file. Reading cuts files at record borders, so one large file is many tasks.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plectra.sources.map_file import filesystem

#: Bytes that one task reads, and those of one batch.
SPLIT, BATCH = 32 << 20, 4 << 20
_KINDS = {"i": ("long", np.int64, pa.int64()), "u": ("long", np.int64, pa.int64()), "f": ("double", np.float64, pa.float64())}


@dataclass
class Names(WriterCommitMessage):
    names: list[str]


class RawWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.scratch = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, place = filesystem(self.path)
        task, names, out = f"{self.scratch}/{uuid.uuid4().hex}", [], None
        try:
            for batch in iterator:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if not names or names[-1] != name:
                        if out is not None:
                            out.close()
                        names.append(name)
                        target = f"{place}/{task}/{name}"
                        system.create_dir(os.path.dirname(target), recursive=True)
                        out = system.open_output_stream(target)
                    out.write(data)
        finally:
            if out is not None:
                out.close()
        return Names([f"{task}/{n}" for n in names])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = filesystem(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if os.path.basename(old.path) != self.scratch:
                    (system.delete_file if old.type == fs.FileType.File else system.delete_dir)(old.path)
        for written in (n for m in messages if m is not None for n in m.names):
            target = f"{place}/{written.split('/', 2)[2]}"
            system.create_dir(os.path.dirname(target), recursive=True)
            system.move(f"{place}/{written}", target)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of lost or failed tasks go with the job's own folder."""
        system, place = filesystem(self.path)
        if system.get_file_info(f"{place}/{self.scratch}").type == fs.FileType.Directory:
            system.delete_dir(f"{place}/{self.scratch}")


@dataclass
class Range(InputPartition):
    path: str
    first: int
    size: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, kind: np.dtype, split: int):
        self.path, self.kind = path, kind
        self.split = max(1, split // kind.itemsize) * kind.itemsize

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole records of every file; what follows the last whole record of a file is left out."""
        system, place = filesystem(self.path)
        info = system.get_file_info(place)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(place) :].split("/"))), key=lambda f: f.path):
            whole = f.size // self.kind.itemsize * self.kind.itemsize
            out += [Range(f.path, k, min(self.split, whole - k)) for k in range(0, whole, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fields = [(n, _KINDS[self.kind[n].kind]) for n in self.kind.names if self.kind[n].kind in _KINDS]
        if not partition.size:
            return
        system, _ = filesystem(self.path)
        step = max(1, BATCH // self.kind.itemsize) * self.kind.itemsize
        with system.open_input_file(partition.path) as f:
            f.seek(partition.first)
            for k in range(0, partition.size, step):
                rows = np.frombuffer(f.read(min(step, partition.size - k)), self.kind)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n].astype(t), a) for n, (_, t, a) in fields], names=[n for n, _ in fields])


class RawFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_files"

    def _kind(self) -> np.dtype:
        return np.dtype([(str(n), str(t)) for n, t in json.loads(self.options["record"])])

    def schema(self) -> str:
        kind = self._kind()
        return ", ".join(f"{n} {_KINDS[kind[n].kind][0]}" for n in kind.names if kind[n].kind in _KINDS)

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], self._kind(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "overwrite", placed: bool = False) -> None:
    """rows(path string, seq, content string or binary): a file for each path below the folder.

    placed: the rows of a path stand together in one partition and in order already, so they are put out as they stream by.
    """
    rows.sparkSession.dataSource.register(RawFiles)
    dealt = rows.select("path", "seq", rows["content"].cast("binary").alias("content"))
    if not placed:
        dealt = dealt.repartition("path").sortWithinPartitions("path", "seq")
    dealt.write.format("raw_files").mode(mode).save(path)


def read_records(spark: SparkSession, path: str, kind: np.dtype, split: int = SPLIT) -> DataFrame:
    """The numbers of fixed-width records of all files below a path; fields of raw bytes are skipped."""
    spark.dataSource.register(RawFiles)
    record = json.dumps([(n, kind[n].str) for n in kind.names])
    return spark.read.format("raw_files").options(record=record, split=split).load(path)
