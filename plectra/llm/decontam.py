"""Benchmark decontamination with spaced seeds.

Words are runs of anything but ASCII white space and punctuation, ASCII letters lower-cased. Each mask picks
five of up to eight neighbouring words and ignores the others, so a substituted word breaks some seeds of a
passage but not all. Seeds of the benchmark are joined with seeds of the documents; a fixed-size bitmap of
the benchmark's seeds goes to the tasks first, so that only seeds that may match are shuffled. Around every
hit the two texts are laid side by side, and the best overlap is, of all stretches in which at least four of five
words are equal, the one with the most equal words. A document is contaminated by an item if such an overlap has 13
equal words, or four of five words of a shorter item; items of under eight words have seeds without a gap alone, so
all their words must be equal, and items of under five have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm.common import small_batches, stored

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 7))
#: Equal words that make an overlap, cost of a different one, and bits of the bitmap (8 MB, whatever the benchmark's size).
EQUAL, DIFFERENT, BITS = 13, 4, 1 << 26
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_STEP = np.array([0x9E3779B97F4A7C15 ** (i + 1) % 2**64 | 1 for i in range(8)], np.uint64)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def seeds(h: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask, the seed at every position where it fits."""
    for k, mask in enumerate(MASKS):
        n = len(h) - mask[-1]
        if n <= 0:
            continue
        total = np.full(n, k + 1, np.uint64)
        for i, at in enumerate(mask):
            total += h[at : at + n] * _STEP[i]
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (total ^ (total >> np.uint64(29))).view(np.int64)


def _seed_rows(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            ids, seed, at = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for found in seeds(hashed(words(text or b""))):
                    if bits is None:
                        hit = np.arange(len(found))
                    else:
                        bit = found & (BITS - 1)
                        hit = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    if len(hit):
                        ids.append(np.full(len(hit), doc, np.int64))
                        seed.append(found[hit])
                        at.append(hit)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids, seed, at)], names=["id", "seed", "at"])

    return run


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the most equal words, at least four of five of its words; the first of several."""
    score = np.r_[0, np.cumsum(np.where(equal, 1, -DIFFERENT))]
    count = np.r_[0, np.cumsum(equal)]
    # From each start, the last end at which the score has not fallen below the start's.
    later = np.maximum.accumulate(score[::-1])[::-1]
    last = np.searchsorted(-later, -score, side="right") - 1
    start = int(np.argmax(count[last] - count))
    inside = np.flatnonzero(equal[start : last[start]])
    if not len(inside):
        return 0, 0, 0
    return start + int(inside[0]), start + int(inside[-1]) + 1, len(inside)


def needed(words_of_item: int) -> int:
    """Equal words that make an overlap with an item of so many words."""
    return min(EQUAL, words_of_item - words_of_item // (DIFFERENT + 1) if words_of_item >= 8 else words_of_item)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            a, b = hashed(words((row["text"] or "").encode())), hashed(words((row["item"] or "").encode()))
            best = (0, 0, 0, 0)
            for diagonal in row["diagonals"]:
                first, last = max(0, -diagonal), min(len(b), len(a) - diagonal)
                if last <= first:
                    continue
                start, end, n = best_overlap(a[first + diagonal : last + diagonal] == b[first:last])
                best = max(best, (n, first + diagonal + start, first + start, end - start))
            if best[0] and best[0] >= needed(len(b)):
                out.append((row["doc_id"], row["item_id"], *best))
        names = ["doc_id", "item_id", "n_equal", "doc_start", "item_start", "n_words"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> a row per contaminated pair.

    Columns: doc_id, item_id, n_equal, doc_start, item_start, n_words (the longest overlap, in words).
    Null and empty texts, and items of under five words, match nothing; rows without an id are not searched,
    rows that repeat an id count as one: the best overlap of any of them. Very long texts are searched whole. Of
    overlaps with equally many equal words the one furthest into the document counts. Other columns are left out; an
    empty table on either side gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = "id long, seed long, at long"
    known = stored(items.mapInArrow(_seed_rows(None), schema))
    place = F.pmod("seed", F.lit(BITS)) + 1
    maps = known.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in maps.collect():  # BITS bits at most
        bits[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    held = spark.sparkContext.broadcast(bits)
    found = plain.mapInArrow(_seed_rows(held), schema)
    hits = found.select(F.col("id").alias("doc_id"), "seed", F.col("at").alias("d")).join(known.select(F.col("id").alias("item_id"), "seed", F.col("at").alias("i")), "seed")
    pairs = stored(hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("d") - F.col("i")).alias("diagonals")))
    held.destroy()  # else every worker keeps it
    sides = pairs.join(plain.select(F.col("id").alias("doc_id"), "text"), "doc_id").join(items.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
    rows = sides.select("doc_id", "item_id", "diagonals", "text", "item").mapInArrow(_verified, "doc_id long, item_id long, n_equal long, doc_start long, item_start long, n_words long")
    best = F.max(F.struct("n_equal", "doc_start", "item_start", "n_words")).alias("x")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose document is contaminated by no item."""
    bad = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["bad_id"], "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
