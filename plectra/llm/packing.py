"""Packing documents into fixed-length sequences: best fit, then swap-based local search.

A document is its token ids with an end id; one longer than a sequence is cut into full pieces, the first of
which may be shorter. Full pieces are sequences of their own. The others are dealt at random into groups of
bounded size (as many groups as the row count asks for), and each group is packed in one task: best fit in
falling length, then a local search that moves a document or exchanges one for one or two for one between
underfull bins, whenever this raises the sum of squared fills, until bins run empty and nothing helps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm import tokens
from plectra.llm.common import small_batches, stored

LENGTH, END = 2048, 0
#: Pieces meant for one group, and local-search steps for each underfull bin.
GROUP, STEPS = 20_000, 8


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, list[int]]:
    """(bin of each piece, fill of each bin), taking pieces by falling length into the fullest bin that fits."""
    where, fills = np.empty(len(lengths), np.int64), []
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0  # bit g: some bin has a gap of g
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = open_[gap].pop()
            if not open_[gap]:
                mask &= ~(1 << gap)
        else:
            b, gap = len(fills), room
            fills.append(0)
        fills[b] += n
        where[i] = b
        open_[gap - n].append(b)
        if gap > n:
            mask |= 1 << (gap - n)
    return where, fills


def local_search(lengths: np.ndarray, where: np.ndarray, fills: list[int], room: int, steps: int = STEPS) -> np.ndarray:
    """Moves and exchanges between underfull bins that raise the sum of squared fills."""
    fill = np.array(fills, np.int64)
    thin = np.flatnonzero(fill < room)
    if len(thin) < 2:
        return where
    where = where.copy()
    pieces = np.flatnonzero(np.isin(where, thin))
    size, home = lengths[pieces].astype(np.int64), where[pieces]
    left = steps * len(thin)
    for donor in thin[np.argsort(fill[thin], kind="stable")]:
        while left > 0 and fill[donor] > 0:
            left -= 1
            mine = np.flatnonzero(home == donor)
            others = home != donor
            upper = others & (fill[home] >= fill[donor])
            grown = size + room - fill[home]  # the largest that may take a piece's place
            best = (0, None, None)
            offers = [(i,) for i in mine] + [(i, j) for a, i in enumerate(mine[:8]) for j in mine[a + 1 : 8]]
            gaps = room - fill[thin]
            for offer in offers:
                n = int(size[list(offer)].sum())
                if len(offer) == 1:
                    fits = (gaps >= n) & (thin != donor) & (fill[thin] >= fill[donor] - n) & (fill[thin] > 0)
                    if fits.any():
                        to = thin[fits][np.argmin(gaps[fits])]
                        gain = 2 * n * int(fill[to] - fill[donor] + n)
                        if gain > best[0]:
                            best = (gain, offer, -int(to) - 1)
                found = np.flatnonzero(upper & (size < n) & (n <= grown))
                if len(found):
                    d = n - size[found]
                    gains = 2 * d * (fill[home[found]] - fill[donor] + d)
                    k = int(np.argmax(gains))
                    if gains[k] > best[0]:
                        best = (int(gains[k]), offer, int(found[k]))
            if best[1] is None:
                break
            out, back = list(best[1]), best[2]
            to = -back - 1 if back < 0 else int(home[back])
            moved = int(size[out].sum()) - (int(size[back]) if back >= 0 else 0)
            home[out] = to
            if back >= 0:
                home[back] = donor
            fill[to] += moved
            fill[donor] -= moved
    where[pieces] = home
    return where


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for batch in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            for d, ids in zip(batch.column(0).to_pylist(), coder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(np.frombuffer(ids, coder.kind).astype("<u4"), np.uint32(end)).tobytes()
                n = len(ids) // 4
                first = n % length or length
                cuts = [0, *range(min(first, n), n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d), piece.append(k), start.append(a), size.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _packed(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy()
        where, fills = best_fit(sizes, length)
        where = local_search(sizes, where, fills, length)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(sizes[order])
        begins = ends - sizes[order]
        firsts = np.r_[True, where[order][1:] != where[order][:-1]]
        offset = np.empty(len(rows), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(firsts, begins, 0))
        group = int(rows["g"].iloc[0])
        return rows.assign(sequence_id=(group << 32) + where, offset=offset).drop(columns="g")

    return run


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Null and empty texts are the end id alone. Rows without a doc_id, and rows that repeat one, are packed
    like any other. Other columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = stored(plain.mapInArrow(_pieces(vocabulary or tokens.default_vocabulary(), length, end), columns))
    row = F.monotonically_increasing_id()
    full = cut.where(F.col("length") == length).select("*", (-row - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // GROUP))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64(row), F.lit(groups)))
    return full.union(dealt.groupBy("g").applyInPandas(_packed(length), f"{columns}, sequence_id long, offset long"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
