"""Quality rules: repetition found with suffix arrays, beside fixed counts.

A text is its words (split at ASCII white space). The suffix array over words comes from prefix doubling,
many documents a batch at once: the first rank is (document, word), so no repeat crosses a document.
The longest common prefixes of neighbouring suffixes give, for each position, the longest substring that
starts there and occurs again (its interval in the array); substrings of REPEAT words or more are maximal
repeats, the union of their spans is the covered part. A document is rejected if that part, or its longest
repeat, is too large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm.common import small_batches

#: Words of the shortest repeat that counts; covered share, and the longest repeat in words and as a share.
REPEAT, COVERED, LONGEST, LONGEST_SHARE = 5, 0.40, 100, 0.10
#: Words from which a batch of documents goes through one suffix array.
AT_ONCE = 400_000
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_WORD = re.compile(rb"[^ \t-\r]")


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each row) of rows compared by keys, the first key first."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and starts elsewhere, too.

    symbols: word numbers of several documents, no number in two of them; ends: each position's document end.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    levels = [symbols.astype(np.int64)]
    # Only positions that share their first 2^k words with another one are ranked further; an untied
    # position's rank may stay, as it equals no other.
    rank = _ranked(levels[0])[1]
    levels[0] = rank.copy()
    step = 1
    while True:
        counts = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            break
        ahead = tied + step
        second = np.where(ahead < ends[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order, sub = _ranked(rank[tied], second)
        if sub.max() + 1 == len(np.unique(rank[tied])):
            break  # ties that no further word resolves do not exist: ends differ
        # New ranks inside each tied group keep the group's place: rank = start of group + position of tie.
        start = np.zeros(n + 1, np.int64)
        start[1:] = np.cumsum(counts)
        rank = start[rank] if len(levels) == 1 else rank
        base = rank[tied][order]
        first = np.r_[True, base[1:] != base[:-1]]
        within = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        s = sub[order]
        same = np.r_[False, s[1:] == s[:-1]]
        place = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
        new_rank = base + (within - (np.arange(len(order)) - place))
        rank = rank.copy()
        rank[tied[order]] = new_rank
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n + 1, np.int64)
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < ends[a]) & (j < ends[b])
        level = levels[k]
        same = inside & (level[np.minimum(i, n - 1)] == level[np.minimum(j, n - 1)])
        common += np.where(same, 1 << k, 0)
    lcp[1:n] = common
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:n], lcp[1:])
    return out


def covered_words(repeat: np.ndarray, least: int) -> int:
    """Words in the union of spans [p, p + repeat[p]) with repeat[p] >= least."""
    starts = np.flatnonzero(repeat >= least)
    if not len(starts):
        return 0
    edge = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + repeat[starts], -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _in_repeated_windows(symbols: np.ndarray, size: int = 3) -> int:
    """Words in windows of `size` words that occur twice or more."""
    n = len(symbols) - size + 1
    if n < 2:
        return 0
    key = symbols[:n].copy()
    for i in range(1, size):
        key = np.unique(key, return_inverse=True)[1] * (int(symbols.max()) + 1) + symbols[i : i + n]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(n + size, bool)
    for i in range(size):
        hit[i : i + n] |= counts[back] > 1
    return int(hit.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def measured(texts: list[bytes]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest) of each text."""
    out: list[tuple[int, ...]] = []
    held: list[tuple[int, int, int, int, int]] = []
    parts: list[np.ndarray] = []
    offset = 0

    def flush() -> None:
        nonlocal offset
        sizes = [len(p) for p in parts]
        total = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) if parts else total
        found, at = longest_repeats(total, ends), 0
        for base, size in zip(held, sizes, strict=True):
            mine = found[at : at + size]
            out.append((*base, covered_words(mine, REPEAT), int(mine.max(initial=0))))
            at += size
        held.clear(), parts.clear()
        offset = 0

    for text in texts:
        words = text.split()
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        chars = sum(map(len, words)) - sum(map(_continuations, (text,)))
        held.append((len(words), chars, len(_SYMBOLS.findall(text)), _dup_lines(text), _in_repeated_windows(own)))
        parts.append(own + offset)
        offset += len(numbers)
        if sum(map(len, parts)) >= AT_ONCE:
            flush()
    flush()
    return out


def _continuations(text: bytes) -> int:
    """UTF-8 bytes that do not begin a code point."""
    if text.isascii():
        return 0
    return int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = measured([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *names])


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limit = F.greatest(F.lit(LONGEST), F.floor(LONGEST_SHARE * F.col("n_words")))
    fine = (F.col("n_covered") <= COVERED * F.col("n_words")) & (F.col("longest_repeat") <= limit)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def quality_report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> counts, base_failed and kept, a row per row.

    A null, empty or word-less text has zero counts and fails (under 50 words). Rows without a doc_id, and
    rows that repeat one, are judged like any other. Other columns are left out; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return _verdict(plain.mapInArrow(_measure, f"row long, {_COLUMNS}").withColumnRenamed("row", "doc_id"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        keep = []
        for n, _, _, _, repeat, covered, longest in measured([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]):
            base = n < 50 or 100 * repeat > 50 * n
            keep.append(not base and covered <= COVERED * n and longest <= max(LONGEST, int(LONGEST_SHARE * n)))
        yield batch.filter(pa.array(keep, pa.bool_()))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns; texts are judged where they lie, without a shuffle."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_judge, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
