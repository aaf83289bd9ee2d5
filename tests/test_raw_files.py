"""Files of given bytes: what is on disk, retried tasks, record borders; pair text with headers."""

import os

import numpy as np
import pytest

from plectra.sources import file_forms as FF
from plectra.sources import matrix_files as MX
from plectra.sources import pairs_text as P
from plectra.sources import raw_files as RF

CELLS = "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double"


def on_disk(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.startswith(("_", "."))}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1, 1, 10, 0, 2, 5.0), (1, 1, 10, 1, 1, 2.5), (1, 2, 10, 3, 0, 1.0), (1, 1, 10, 0, 0, 4.0)], CELLS)


def test_bytes(spark, cells, tmp_path):
    chroms = spark.createDataFrame([(1, 30), (2, 20)], "idx long, len long")
    RF.write_files(FF.triples(cells, 2), f"{tmp_path}/t")
    assert on_disk(f"{tmp_path}/t") == {"1_1_10/0.txt": b"0\t0\t4\n10\t10\t2.5\n", "1_1_10/1.txt": b"0\t20\t5\n", "1_2_10/0.txt": b"30\t0\t1\n"}
    RF.write_files(FF.dense_rows(cells, chroms), f"{tmp_path}/d")
    assert on_disk(f"{tmp_path}/d") == {"1_1_10/0.txt": b"4\t0\t5\n0\t2.5\t0\n5\t0\t0\n"}
    RF.write_files(FF.binary_cells(cells.where("chr2 = 1")), f"{tmp_path}/b")
    due = np.array([(0, 0, 4), (1, 1, 2.5), (0, 2, 5)], MX.CELL)
    assert on_disk(f"{tmp_path}/b") == {"1_1_10/0.bin": due.tobytes()}
    vector = spark.createDataFrame([(10, 1, 0, 1.5), (10, 1, 1, 2.0), (10, 1, 4, 3.0)], "bin_size long, chr long, bin long, value double")
    RF.write_files(FF.fixed_step(vector), f"{tmp_path}/w")
    assert on_disk(f"{tmp_path}/w") == {"1_10.wig": b"fixedStep chrom=1 start=1 step=10 span=10\n1.5\n2.0\nfixedStep chrom=1 start=41 step=10 span=10\n3.0\n"}
    loop = spark.createDataFrame([(1, 10, 20, 1, 50, 60, "1,2,3", {"score": "9", "upSign": "1"})], "chr1 long, start1 long, end1 long, chr2 long, start2 long, end2 long, color string, attributes map<string,string>")
    RF.write_files(FF.features(loop, "domains"), f"{tmp_path}/f")
    head = "\t".join([*FF.FEATURE, *FF.LAYOUTS["domains"]])
    assert on_disk(f"{tmp_path}/f") == {"1_1.bedpe": f"{head}\n1\t10\t20\t1\t50\t60\t.\t.\t.\t.\t1,2,3\t9\tnull\tnull\t1\tnull\n".encode()}


def test_overwriting_and_retries(spark, tmp_path):
    path = f"{tmp_path}/o"
    rows = spark.createDataFrame([("a/x.txt", 2, "two"), ("a/x.txt", 1, "one "), ("b.txt", 1, "b")], "path string, seq int, content string")
    RF.write_files(rows, path)
    assert on_disk(path) == {"a/x.txt": b"one two", "b.txt": b"b"}
    RF.write_files(rows.where("path = 'b.txt'"), path)
    assert on_disk(path) == {"b.txt": b"b"}
    RF.write_files(rows.where("path <> 'b.txt'"), path, "append")
    assert set(on_disk(path)) == {"a/x.txt", "b.txt"}
    writer = RF.RawWriter(path, False)
    batch = rows.selectExpr("'c.txt' as path", "seq", "cast(content as binary) as content").limit(1).toArrow().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))
    assert lost.names != kept.names
    writer.commit([kept, None])
    assert set(on_disk(path)) == {"a/x.txt", "b.txt", "c.txt"} and len(os.listdir(path)) == 3


@pytest.mark.parametrize("split", [1, 12, 25, 1 << 20])
def test_record_borders(spark, tmp_path, split):
    rows = np.zeros(7, MX.CELL)
    rows["bin_x"], rows["counts"] = np.arange(7), np.arange(7) / 2
    os.makedirs(f"{tmp_path}/r/sub")
    open(f"{tmp_path}/r/one.bin", "wb").write(rows[:5].tobytes() + b"half")
    open(f"{tmp_path}/r/sub/two.bin", "wb").write(rows[5:].tobytes())
    open(f"{tmp_path}/r/_hidden", "wb").write(b"x" * 24)
    df = RF.read_records(spark, f"{tmp_path}/r", MX.CELL, split)
    assert sorted((r.bin_x, r.counts) for r in df.collect()) == [(k, k / 2) for k in range(7)]
    assert df.rdd.getNumPartitions() == (7 if split < 24 else 4 if split == 25 else 2)


def test_headers_of_pair_text(spark, tmp_path):
    comments = "# made by a program\n" * 3000
    open(f"{tmp_path}/a.txt", "w").write(comments + "\n0 1 5 0 16 2 9 1\n")
    got = P.read_pairs(spark, f"{tmp_path}/a.txt").collect()
    assert [(r.chr1, r.pos1, r.strand2, r.frag2) for r in got] == [("1", 5, False, 1)]
    open(f"{tmp_path}/b.txt", "w").write(comments + "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\nr 1 5 2 9 + -\n")
    got = P.read_pairs(spark, f"{tmp_path}/b.txt").collect()
    assert [(r.chr2, r.pos2, r.strand1, r.strand2, r.mapq1) for r in got] == [("2", 9, True, False, 1000)]
    open(f"{tmp_path}/c.txt", "w").write(comments)
    assert P.read_pairs(spark, f"{tmp_path}/c.txt").collect() == []
    open(f"{tmp_path}/d.txt", "w").write("1 2 3\n")
    with pytest.raises(ValueError, match="3 columns"):
        P.read_pairs(spark, f"{tmp_path}/d.txt")
