"""Contact-map files as a Spark data source, for reading and writing.

A map is a file or a folder of files, each complete in itself: tasks write their own shares of the blocks, and a reader
plans one task per range of blocks over all of them. Bounds on columns (the option `bounds`) choose matrices, blocks and
slices of vectors before any is read. They are an option of each read and no pushed filters, as Spark 4.1 keeps one set of
pushed filters for all scans of a Python source that one DataFrame was loaded from, and so mixes up those of two branches.
The option `table` picks what is read: `cells`, `vectors`, `expected`, `factors`, `chromosomes` or `matrices`.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plectra.sources import map_format as M

#: Compressed bytes of blocks, and values of a vector, that one task reads.
SPLIT_BYTES, SPLIT_VALUES = 8 << 20, 1 << 20
#: Bins a side that the blocks of a written map aim at.
BLOCK_BINS = 500
TABLES = {
    "cells": "chr1 long, chr2 long, unit string, bin_size long, bin_x long, bin_y long, counts double",
    "vectors": "norm string, unit string, bin_size long, chr long, bin long, value double",
    "expected": "norm string, unit string, bin_size long, dist long, value double",
    "factors": "norm string, unit string, bin_size long, chr long, factor double",
    "chromosomes": "idx long, name string, len long",
    "matrices": "chr1 long, chr2 long, unit string, bin_size long, blocks long, bytes long, total double",
}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def map_files(path: str) -> list[str]:
    """The path itself, or the map files in a folder; what a running or failed job left behind is no part of it."""
    system, place = filesystem(path)
    if system.get_file_info(place).type == fs.FileType.File:
        return [place]
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.path.endswith(".hic"))


class Bounds:
    """Per column a value, or a closed range as a pair whose ends may be None."""

    def __init__(self, given: dict):
        self.given = given

    def range(self, name: str) -> tuple[float, float]:
        given = self.given.get(name, (None, None))
        low, high = given if isinstance(given, (list, tuple)) else (given, given)
        return -math.inf if low is None else low, math.inf if high is None else high

    def allows(self, name: str, value) -> bool:
        if isinstance(value, str):
            return self.given.get(name, value) == value
        low, high = self.range(name)
        return low <= value <= high


@dataclass
class Blocks(InputPartition):
    path: str
    version: int
    keys: tuple
    places: np.ndarray


@dataclass
class Slice(InputPartition):
    path: str
    kind: str
    keys: tuple
    first: int
    n: int
    at: int


@dataclass
class Rows(InputPartition):
    rows: list


class MapReader(DataSourceReader):
    def __init__(self, path: str, table: str, bounds: Bounds):
        self.path, self.table, self.bounds = path, table, bounds
        self.names = [x.split()[0] for x in TABLES[table].split(", ")]

    def partitions(self) -> list[InputPartition]:
        system, _ = filesystem(self.path)
        out: list[InputPartition] = []
        for path in map_files(self.path):
            with system.open_input_file(path) as file:
                header = M.read_header(file)
                matrices, expected, vectors = M.read_footer(file, header)
                if self.table in ("cells", "matrices"):
                    out += self._matrices(path, file, header, matrices)
                elif self.table == "chromosomes":
                    out.append(Rows([(i, name, n) for i, (name, n) in enumerate(header.chromosomes)]))
                elif self.table == "factors":
                    out.append(Rows([(v.norm, v.unit, v.bin_size, c, f) for v in expected for c, f in v.factors.items()]))
                else:
                    for v in vectors if self.table == "vectors" else expected:
                        out += self._slices(path, header, v)
        return out or [Rows([])]

    def _matrices(self, path: str, file, header: M.Header, matrices: dict) -> Iterator[InputPartition]:
        allows = self.bounds.allows
        for key, (at, _) in matrices.items():
            chr1, chr2 = map(int, key.split("_"))
            if not (allows("chr1", chr1) and allows("chr2", chr2)):
                continue
            for zoom in M.read_zooms(file, at):
                if not (allows("bin_size", zoom.bin_size) and allows("unit", zoom.unit)):
                    continue
                keys = (chr1, chr2, zoom.unit, zoom.bin_size)
                if self.table == "matrices":
                    yield Rows([(*keys, len(zoom.blocks), int(zoom.blocks["size"].sum()), zoom.total)])
                    continue
                held = zoom.blocks[M.overlapping(zoom, header, self.bounds.range("bin_x"), self.bounds.range("bin_y"))]
                held = held[np.argsort(held["at"])]
                share = np.cumsum(held["size"], dtype=np.int64) // SPLIT_BYTES
                for part in np.split(held, np.flatnonzero(np.diff(share)) + 1):
                    if len(part):
                        yield Blocks(path, header.version, keys, part)

    def _slices(self, path: str, header: M.Header, v: M.Vector) -> Iterator[InputPartition]:
        allows, own = self.bounds.allows, self.names[3 if self.table == "expected" else 4]
        if not (allows("norm", v.norm) and allows("unit", v.unit) and allows("bin_size", v.bin_size) and (v.chr is None or allows("chr", v.chr))):
            return
        keys = (v.norm, v.unit, v.bin_size) if v.chr is None else (v.norm, v.unit, v.bin_size, v.chr)
        low, high = self.bounds.range(own)
        first, end = int(max(0, low)) if low > -math.inf else 0, int(min(v.n - 1, high)) + 1 if high < math.inf else v.n
        for k in range(first, end, SPLIT_VALUES):
            n = min(SPLIT_VALUES, end - k)
            yield Slice(path, header.number.str, keys, k, n, v.at + k * header.number.itemsize)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(self.table)
        if isinstance(partition, Rows):
            yield pa.RecordBatch.from_pylist([dict(zip(self.names, r, strict=True)) for r in partition.rows], schema)
            return
        system, _ = filesystem(self.path)
        with system.open_input_file(partition.path) as file:
            if isinstance(partition, Slice):
                file.seek(partition.at)
                values = M.Cursor(file, partition.at).array(partition.kind, partition.n).astype(np.float64)
                yield _batch(schema, partition.keys, [np.arange(partition.first, partition.first + partition.n), values])
                return
            (x1, x2), (y1, y2) = self.bounds.range("bin_x"), self.bounds.range("bin_y")
            for entry in partition.places:
                file.seek(int(entry["at"]))
                x, y, v = M.decode_block(file.read(int(entry["size"])), partition.version)
                near = (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)
                yield _batch(schema, partition.keys, [x[near], y[near], v[near]])


def _arrow_schema(table: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in TABLES[table].split(", "))])


def _batch(schema: pa.Schema, keys: tuple, columns: list[np.ndarray]) -> pa.RecordBatch:
    n = len(columns[0])
    fixed = [pa.repeat(pa.scalar(k, schema.field(i).type), n) for i, k in enumerate(keys)]
    return pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, schema.field(len(keys) + i).type) for i, c in enumerate(columns))], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str


class MapWriter(DataSourceArrowWriter):
    """Each task writes one complete map file of the groups that it gets; commit moves the files of the tasks that count into the folder."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.table, self.overwrite = options["path"], options.get("table", "cells"), overwrite
        self.version = int(options.get("version", "9"))
        self.chromosomes = [tuple(x) for x in json.loads(options["chromosomes"])]
        self.genome, self.block_bins = options.get("genome", ""), int(options.get("block_bins", BLOCK_BINS))
        self.sizes = json.loads(options.get("bin_sizes", "[]"))
        self.scratch = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        header = M.Header(self.version, 0, self.genome, {}, self.chromosomes, self.sizes, [])
        data = M.assemble(header, *(self._cells(iterator) if self.table == "cells" else self._vectors(iterator)))
        system, place = filesystem(self.path)
        name = f"{place}/{self.scratch}/part-{uuid.uuid4().hex}.hic"
        system.create_dir(os.path.dirname(name), recursive=True)
        with system.open_output_stream(name) as out:
            for piece in data:
                out.write(piece)
        return Written(name)

    def _groups(self, batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        """Neighbouring rows of equal keys, which come first among the columns; a group may span batches."""
        held, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            new = np.zeros(batch.num_rows, bool)
            for c in columns[:keys]:
                new[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key = tuple(c[a] if isinstance(c[a], str) else int(c[a]) for c in columns[:keys])
                if key != held and rows:
                    yield held, [np.concatenate(c) for c in zip(*rows, strict=True)]
                    rows = []
                held = key
                rows.append([c[a:b] for c in columns[keys:]])
        if rows:
            yield held, [np.concatenate(c) for c in zip(*rows, strict=True)]

    def _cells(self, batches: Iterator[pa.RecordBatch]) -> tuple[list, list, list]:
        zooms: dict[tuple, tuple[list, list, list]] = {}
        for (chr1, chr2, bin_size, number), (x, y, v) in self._groups(batches, 4):
            numbers, blocks, totals = zooms.setdefault((chr1, chr2, bin_size), ([], [], []))
            numbers.append(number)
            blocks.append(M.encode_block(x, y, v, self.version))
            totals.append(float(np.where((x != y) & (chr1 == chr2), 2 * v, v).sum()))
        out = []
        for (chr1, chr2, bin_size), (numbers, blocks, totals) in zooms.items():
            index = np.zeros(len(numbers), M.BLOCK_ENTRY)
            index["number"] = numbers
            grid = M.grid_of(max(self.chromosomes[c][1] for c in (chr1, chr2)), bin_size, self.block_bins)
            out.append((M.Zoom(chr1, chr2, "BP", bin_size, *grid, sum(totals), index), blocks))
        return out, [], []

    def _vectors(self, batches: Iterator[pa.RecordBatch]) -> tuple[list, list, list]:
        """Vectors (norm, bin_size, chr, bin, value), or expectations where chr is -1; bins without a value are NaN."""
        vectors, expected = [], []
        for (norm, bin_size, chr_), (bins, values) in self._groups(batches, 3):
            n = int(bins.max()) + 1 if chr_ < 0 else self.chromosomes[chr_][1] // bin_size + 1
            dense = np.full(n, np.nan)
            dense[bins] = values
            own = M.Vector(norm, "BP", bin_size, None if chr_ < 0 else chr_, n, 0)
            (expected if chr_ < 0 else vectors).append((own, dense))
        return [], expected, vectors

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = filesystem(self.path)
        if self.overwrite:
            for old in map_files(self.path):
                system.delete_file(old)
        for m in messages:
            if m is not None:
                system.move(m.path, f"{place}/{os.path.basename(m.path)}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of lost or failed tasks go with the job's own folder."""
        system, place = filesystem(self.path)
        if system.get_file_info(f"{place}/{self.scratch}").type == fs.FileType.Directory:
            system.delete_dir(f"{place}/{self.scratch}")


class ContactMap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_map"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "cells")]

    def reader(self, schema) -> MapReader:
        return MapReader(self.options["path"], self.options.get("table", "cells"), Bounds(json.loads(self.options.get("bounds", "{}"))))

    def writer(self, schema, overwrite: bool) -> MapWriter:
        return MapWriter(self.options, overwrite)


def read_map(spark: SparkSession, path: str, table: str = "cells", **bounds) -> DataFrame:
    """A table of a map file or of a folder of them; bounds by column, a value or a closed range (low, high) of numbers.

    Only rows within the bounds come out, and only the matrices, blocks and slices of vectors that may hold such rows are read.
    """
    spark.dataSource.register(ContactMap)
    return spark.read.format("contact_map").options(table=table, bounds=json.dumps(bounds)).load(path)


def region_of_map(spark: SparkSession, path: str, bin_size: int, chr1: int, x1: int, x2: int, chr2: int, y1: int, y2: int) -> DataFrame:
    """Cells of one matrix whose bin starts lie in a closed region, mirrored inside a chromosome; only its blocks are read."""
    if chr1 > chr2:
        chr1, x1, x2, chr2, y1, y2 = chr2, y1, y2, chr1, x1, x2

    def part(a1: int, a2: int, b1: int, b2: int) -> DataFrame:
        at = lambda low, high: (-(-low // bin_size), high // bin_size)
        return read_map(spark, path, bin_size=bin_size, chr1=chr1, chr2=chr2, bin_x=at(a1, a2), bin_y=at(b1, b2))

    direct = part(x1, x2, y1, y2)
    if chr1 != chr2 or (x1, x2) == (y1, y2):
        return direct
    seen = (F.col("bin_x") * bin_size).between(x1, x2) & (F.col("bin_y") * bin_size).between(y1, y2)
    return direct.unionByName(part(y1, y2, x1, x2).where(~seen))


def _options(chroms: DataFrame, version: int, genome: str) -> dict[str, str]:
    """chroms(idx, len[, name]): a row a chromosome; place 0 is kept for the whole genome."""
    name = F.col("name") if "name" in chroms.columns else F.col("idx").cast("string")
    rows = {r.idx: (r.name, r.len) for r in chroms.select("idx", name.alias("name"), "len").collect()}
    whole = ("ALL", sum(n for _, n in rows.values()) // 1000)
    listed = [rows.get(i, whole if i == 0 else (str(i), 0)) for i in range(max(rows, default=0) + 1)]
    return {"version": str(version), "genome": genome, "chromosomes": json.dumps(listed)}


def write_map(cells: DataFrame, chroms: DataFrame, path: str, version: int = 9, genome: str = "", mode: str = "overwrite", block_bins: int = BLOCK_BINS) -> None:
    """Cells (chr1, chr2, bin_size, bin_x, bin_y, counts) as a folder of map files, blocks dealt over tasks.

    A block is the unit of the shuffle: the grid bounds its bins near the diagonal, so one chromosome is many tasks.
    """
    cells.sparkSession.dataSource.register(ContactMap)
    options = _options(chroms, version, genome) | {"block_bins": str(block_bins)}
    listed = json.loads(options["chromosomes"])
    sizes = sorted(r.bin_size for r in cells.select("bin_size").distinct().collect())  # a row a resolution
    lengths = F.array(*(F.lit(n).cast("long") for _, n in listed))
    longest = F.greatest(*(F.element_at(lengths, (F.col(c) + 1).cast("int")) for c in ("chr1", "chr2")))
    grid = cells.withColumn("bins__", longest).withColumn("bins__", F.expr("bins__ div bin_size + 1"))
    grid = grid.withColumn("columns__", F.expr(f"bins__ div {block_bins} + 1")).withColumn("side__", F.expr("bins__ div columns__ + 1"))
    by_row = "(bin_y div side__) * columns__ + bin_x div side__"
    along = "cast(floor(log2(1 + abs(bin_x - bin_y) / sqrt(2.0D) / side__)) as long) * columns__ + ((bin_x + bin_y) div 2) div side__"
    block = F.when((F.col("chr1") == F.col("chr2")) & F.lit(version > 8), F.expr(along)).otherwise(F.expr(by_row))
    keys = ["chr1", "chr2", "bin_size", "block"]
    dealt = grid.withColumn("block", block).select(*keys, "bin_x", "bin_y", "counts").repartition(*keys).sortWithinPartitions(*keys)
    dealt.write.format("contact_map").options(**options, bin_sizes=json.dumps(sizes)).mode(mode).save(path)


def append_vectors(vectors: DataFrame, chroms: DataFrame, path: str, norm: str, version: int = 9) -> None:
    """Adds vectors (bin_size, chr, bin, value) to a map under a norm's name; with `dist` instead of chr and bin, an expectation."""
    vectors.sparkSession.dataSource.register(ContactMap)
    own = ["chr", "bin"] if "chr" in vectors.columns else [F.lit(-1).cast("long").alias("chr"), F.col("dist").alias("bin")]
    rows = vectors.select(F.lit(norm).alias("norm"), "bin_size", *own, "value")
    keys = ["norm", "bin_size", "chr"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "bin").write.format("contact_map").options(**_options(chroms, version, ""), table="vectors").mode("append").save(path)
