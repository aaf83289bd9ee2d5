"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are renumbered by how often the whole corpus uses them (ties by id), so that frequent ones take one
byte. A block holds some documents: their ids and lengths, two control bits a token (bytes that its rank
takes, less one; four tokens a control byte, lowest bits first), and the rank bytes, little-endian. Blocks
lie in ascending doc_id order in one file a range partition; a second table holds the ranks.
Both are written by Spark's committed writer into the shared folder, so a lost executor's tasks are
repeated and only whole files are ever seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectra.llm import tokens
from plectra.llm.common import discard, scratch_dir, small_batches, stored

END = 2
#: Tokens after which a block is closed, and tokens meant for one file.
BLOCK, FILE = 1 << 16, 1 << 24
#: Lengths of the four tokens that a control byte describes.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = n - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup of the control bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(size > k)
        out[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(path: str, end: int):
    """A row per document with its ids, and at the end of a task one row with its counts of ids."""

    def row(doc: list[int | None], ids: list[bytes | None], counts: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["id", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        last = np.array([end], coder.kind).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = [x + last for x in coder.encode([t or "" for t in batch.column(1).to_pylist()])]
            found = np.bincount(np.frombuffer(b"".join(ids), coder.kind), minlength=len(total))
            found[: len(total)] += total
            total = found
            yield row(batch.column(0).to_pylist(), ids, [None] * len(ids))
        yield row([None], [None], [total.astype("<i8").tobytes()])

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            total = np.frombuffer(counts, "<i8")
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "c"])


def _blocks(rank_of, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, part, block = rank_of.value, TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            control, data = pack(ranks[np.frombuffer(b"".join(held), kind)])
            width = np.dtype(kind).itemsize
            row = [[part], [block], [ids], [[len(x) // width for x in held]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(found)
                size += len(found)
                if size >= BLOCK * np.dtype(kind).itemsize:
                    yield closed()
                    ids, held, size, block = [], [], 0, block + 1
        if held:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end: int = END) -> str:
    """Tokenizes whole texts (null: empty), appends `end`, and writes path/blocks and path/ranks; gives path.

    Rows without a doc_id come first; rows that repeat one stand side by side, ordered by a hash of their ids. Ids
    that are used equally often are ranked by themselves. Very long texts are blocks of their own. Other columns
    are left out. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or scratch_dir(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    vocabulary = vocabulary or tokens.default_vocabulary()
    kind = tokens.encoder(vocabulary).kind
    coded = stored(plain.mapInArrow(_encoded(vocabulary, end), "id long, ids binary, counts binary"))
    counts = coded.where("counts is not null").select("counts").mapInArrow(_histogram, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    used = counts.orderBy(F.desc("c"), "token").collect()  # one row a vocabulary entry, however large the corpus
    order = np.array([r.token for r in used], np.int64)
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    table = [(i, int(t)) for i, t in enumerate(order)]
    spark.createDataFrame(table, "rank int, token long").coalesce(1).write.parquet(f"{path}/ranks")
    files = max(1, -(-sum(r.c for r in used) // FILE))
    laid = coded.where("counts is null").select("id", "ids").repartitionByRange(files, "id", F.xxhash64("ids")).sortWithinPartitions("id", F.xxhash64("ids"))
    ranks = spark.sparkContext.broadcast(rank_of)
    rows = laid.mapInArrow(_blocks(ranks, kind), "part int, block int, ids array<long>, lengths array<long>, control binary, data binary")
    rows.write.option("compression", "none").parquet(f"{path}/blocks")
    ranks.destroy()
    discard(coded)
    return path


def _decoded(token_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_of.value
        for row in (row for batch in batches for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist()):
            n = np.array(row["lengths"], np.int64)
            ids = table[unpack(row["control"], row["data"], int(n.sum()))]
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for k, e in zip(n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), row["part"], np.int32)), pa.array(np.full(len(n), row["block"], np.int32)), pa.array(row["ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                names=["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    token_of = spark.sparkContext.broadcast(np.array([r.token for r in ranks], "<u4"))
    sizes = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("file_start"))
    inside = Window.partitionBy("part").orderBy("block")
    index = sizes.withColumn("block_start", F.sum("n").over(inside) - F.col("n")).join(before, "part").select("part", "block", (F.col("block_start") + F.col("file_start")).alias("base"))
    docs = blocks.mapInArrow(_decoded(token_of), "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(index, ["part", "block"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
