"""Contact-map files of all versions and the partitioned store: round trips, and reads that open only what they need."""

import json
import math
import os
import struct
import zlib

import numpy as np
import pytest

from plectra.operators import binning as B
from plectra.operators import expected as E
from plectra.operators import norm as N
from plectra.plans import fixtures as fx
from plectra.plans.storage import stored
from plectra.sources import map_file as MF
from plectra.sources import map_format as M
from plectra.sources import store as ST


@pytest.mark.parametrize("version", [6, 7, 8, 9])
@pytest.mark.parametrize("width,n", [(1, 1), (20, 50), (18, 300), (30_000, 400)])
@pytest.mark.parametrize("whole", [True, False])
def test_blocks(version, width, n, whole):
    rng = np.random.default_rng(n)
    at = rng.choice(width * width, min(n, width * width), replace=False)
    x, y = at % width + 70_000, at // width + 90_000
    v = rng.integers(1, 32_000, len(at)).astype(float) if whole else rng.random(len(at)).astype("f4").astype(float)
    got = M.decode_block(M.encode_block(x, y, v, version), version)
    assert sorted(zip(*map(list, got), strict=True)) == sorted(zip(x, y, v, strict=True))


def test_wide_blocks_have_wide_bins():
    cells = [(0, 5, 1.0), (40_000, 50_000, 2.5), (3, 70_000, 3.0)]
    x, y, v = (np.array(c) for c in zip(*cells, strict=True))
    assert sorted(zip(*map(list, M.decode_block(M.encode_block(x, y, v, 9), 9)), strict=True)) == sorted(cells)
    with pytest.raises(ValueError, match="span"):
        M.encode_block(x, y, v, 8)


def by_hand(version):
    """A file put together here byte by byte: two cells in a list block, four places in a dense one."""
    text = lambda s: s.encode() + b"\0"
    long_ = "<q" if version > 8 else "<i"
    narrow = struct.pack("<bb", 0, 0) if version > 8 else b""
    first = struct.pack("<iiib", 2, 10, 20, 0) + narrow + b"\1" + struct.pack("<hhhhhhh", 1, 0, 2, 0, 7, 3, 9)
    second = struct.pack("<iiib", 3, 100, 200, 1) + narrow + b"\2" + struct.pack("<ihffff", 4, 2, 1.5, math.nan, 2.5, 3.5)
    blocks = [zlib.compress(first), zlib.compress(second)]
    head = lambda at: (
        text("HIC") + struct.pack("<iq", version, at) + text("g") + (struct.pack("<qq", 0, 0) if version > 8 else b"") + struct.pack("<i", 1) + text("k") + text("v")
        + struct.pack("<i", 2) + text("ALL") + struct.pack(long_, 300) + text("one") + struct.pack(long_, 300_000) + struct.pack("<ii", 1, 1000) + struct.pack("<i", 0)
    )
    a = len(head(0))
    b = a + len(blocks[0])
    matrix_at = b + len(blocks[1])
    index = struct.pack("<iqi", 0, a, len(blocks[0])) + struct.pack("<iqi", 5, b, len(blocks[1]))
    matrix = struct.pack("<iii", 1, 1, 1) + text("BP") + struct.pack("<iffff", 0, 1, 2, 3, 4) + struct.pack("<iiii", 1000, 150, 3, 2) + index
    own = text("1_1") + struct.pack("<qi", matrix_at, len(matrix))
    number = "<fff" if version > 8 else "<ddd"
    factor = struct.pack("<if" if version > 8 else "<id", 1, 0.5)
    expected = text("BP") + struct.pack("<i", 1000) + struct.pack(long_, 3) + struct.pack(number, 4, 2, 1) + struct.pack("<i", 1) + factor
    footer = struct.pack("<i", 1) + own + struct.pack("<i", 1) + expected
    vector_at = matrix_at + len(matrix)
    vector = struct.pack(long_, 3) + struct.pack(number, 1, math.nan, 3)
    tail = struct.pack("<i", 0) + struct.pack("<i", 1) + text("KR") + struct.pack("<i", 1) + text("BP") + struct.pack("<iq", 1000, vector_at) + struct.pack(long_, len(vector))
    return head(vector_at + len(vector)) + b"".join(blocks) + matrix + vector + struct.pack(long_, len(footer)) + footer + tail


@pytest.mark.parametrize("version", [8, 9])
def test_file_made_by_hand(spark, tmp_path, version):
    path = f"{tmp_path}/map.hic"
    with open(path, "wb") as f:
        f.write(by_hand(version))
    got = sorted(tuple(r) for r in MF.read_map(spark, path).collect())
    cells = [(10, 20, 7.0), (13, 20, 9.0), (100, 200, 1.5), (100, 201, 2.5), (101, 201, 3.5)]
    assert got == [(1, 1, "BP", 1000, *c) for c in cells]
    vector = {r.bin: r.value for r in MF.read_map(spark, path, "vectors").collect()}
    assert vector[0] == 1 and math.isnan(vector[1]) and vector[2] == 3
    assert [r.value for r in MF.read_map(spark, path, "vectors", bin=(2, None)).collect()] == [3]
    assert [tuple(r) for r in MF.read_map(spark, path, "expected", dist=(1, 1)).collect()] == [("NONE", "BP", 1000, 1, 2.0)]
    assert [tuple(r) for r in MF.read_map(spark, path, "factors").collect()] == [("NONE", "BP", 1000, 1, 0.5)]
    assert MF.read_map(spark, path, "chromosomes").collect()[1].name == "one"


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    return stored(B.bin_contacts(fx.pairs(spark, sf_dir), [500, 2500, 10_000]))


def rows(df):
    return sorted(tuple(r) for r in df.select(*B.KEYS, "counts").collect())


@pytest.mark.parametrize("version", [8, 9])
def test_written_maps(spark, cells, tmp_path, version):
    path = f"{tmp_path}/m"
    MF.write_map(cells, fx.chroms(spark), path, version, block_bins=25)
    assert rows(MF.read_map(spark, path)) == rows(cells)
    for region in ((500, 1, 20_000, 60_000, 1, 90_000, 150_000), (500, 2, 0, 30_000, 2, 0, 30_000), (2500, 3, 0, 50_000, 1, 10_000, 90_000), (500, 1, 0, 99_000, 1, 50_000, 120_000)):
        due = rows(B.region(cells.where(f"bin_size = {region[0]}"), *region[1:]))
        assert due and rows(MF.region_of_map(spark, path, *region)) == due
        assert rows(B.region(cells, *region[1:], region[0])) == due
    # A region's blocks are few of its matrix, and no block of another matrix is opened.
    held = lambda **b: sum(int(p.places["size"].sum()) for p in MF.MapReader(path, "cells", MF.Bounds(b)).partitions() if isinstance(p, MF.Blocks))
    assert 0 < held(chr1=1, chr2=1, bin_size=500, bin_x=(40, 120), bin_y=(180, 300)) < held(chr1=1, chr2=1, bin_size=500) / 2 < held() / 4
    assert held(chr1=9) == 0
    with pytest.raises(Exception, match="magic"):
        other = f"{tmp_path}/x.hic"
        open(other, "wb").write(b"no map at all")
        MF.read_map(spark, other).collect()


def test_vectors_beside_a_map(spark, cells, tmp_path):
    path = f"{tmp_path}/m"
    MF.write_map(cells, fx.chroms(spark), path, 8)
    vector, expected = stored(N.vanilla_coverage(cells)), stored(E.raw_expected(cells, fx.chroms(spark)))
    MF.append_vectors(vector, fx.chroms(spark), path, "VC", 8)
    MF.append_vectors(expected, fx.chroms(spark), path, "VC", 8)
    assert rows(MF.read_map(spark, path)) == rows(cells)
    got = MF.read_map(spark, path, "vectors", norm="VC").where("not isnan(value)")
    assert sorted(got.select("bin_size", "chr", "bin", "value").collect()) == sorted(vector.select("bin_size", "chr", "bin", "value").collect())
    got = MF.read_map(spark, path, "expected", norm="VC")
    assert sorted(got.select("bin_size", "dist", "value").collect()) == sorted(expected.select("bin_size", "dist", "value").collect())


def test_retried_tasks_leave_one_file(tmp_path):
    options = {"path": f"{tmp_path}/m", "chromosomes": json.dumps([["ALL", 1], ["1", 100]])}
    writer = MF.MapWriter(options, True)
    lost, kept = writer.write(iter([])), writer.write(iter([]))
    writer.commit([kept, None])
    assert os.listdir(f"{tmp_path}/m") == [os.path.basename(kept.path)] and lost.path != kept.path
    failed = MF.MapWriter(options, True)
    failed.write(iter([]))
    failed.abort([None])
    assert len(os.listdir(f"{tmp_path}/m")) == 1


def test_store(spark, cells, tmp_path):
    path = f"{tmp_path}/s"
    ST.write_store(cells, path, band=50)
    assert rows(ST.read_store(spark, path)) == rows(cells)
    region = (1, 20_000, 60_000, 1, 90_000, 150_000)
    found = ST.region_of_store(spark, path, 500, *region)
    assert rows(found) == rows(B.region(cells.where("bin_size = 500"), *region))
    assert rows(ST.region_of_store(spark, path, [500, 10_000], *region)) == rows(B.region(cells.where("bin_size <> 2500"), *region))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2
    for scan in scans:
        assert "bin_size" in scan.split("PartitionFilters: [")[1].split("]")[0] and "chr1" in scan.split("PartitionFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(bin_x," in scan and "LessThanOrEqual(bin_y," in scan
    scanned = found._jdf.queryExecution().executedPlan().collectLeaves()
    files = sum(scanned.apply(i).selectedPartitions().totalNumberOfFiles() for i in range(scanned.size()))
    of_matrix = os.listdir(f"{path}/cells/bin_size=500/chr1=1/chr2=1")
    assert files == 2 * sum(x.endswith(".parquet") for x in of_matrix)
    vector = stored(N.vanilla_coverage(cells))
    ST.append_vectors(vector, path, "VC")
    ST.append_vectors(N.vanilla_coverage(cells, True), path, "VC_SQRT")
    assert sorted(ST.read_vectors(spark, path, "VC").collect()) == sorted(vector.select("bin_size", "chr", "bin", "value").collect())
