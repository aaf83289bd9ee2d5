"""Quality classifier by compression: one zstandard dictionary of good texts, one of bad texts.

A text is cut into pieces of PIECE bytes, and every piece is compressed on its own: with the good dictionary, with
the bad one and with none. Pieces keep a dictionary in reach of all parts of a long text. The differences of the summed
sizes, normalised by each other and by the text's length, go through a logistic curve that is fitted on labelled rows
which the dictionaries have not seen.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm.common import discard, small_batches, stored

#: Labelled rows that are learned from at most, and pieces of each label that a dictionary is built from at most (by hash).
TRAIN_ROWS, TRAIN_PIECES = 20_000, 20_000
#: Bytes of a piece and of a dictionary; zstandard's level.
PIECE, DICTIONARY, LEVEL = 512, 112_640, 3
#: A score from here on predicts a good text.
GOOD = 0.7


def pieces(text: str | None) -> list[bytes]:
    """The whole text in pieces; a text without a character is one empty piece."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)] or [b""]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the samples themselves where they are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of texts under the two dictionaries and under none."""

    def __init__(self, good: bytes, bad: bytes):
        # A dictionary that was not trained has no header, and zstandard then takes it as plain content.
        self.packers = [self._packer(x) for x in (good, bad, b"")]

    @staticmethod
    def _packer(raw: bytes):
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if not raw:
            return zstandard.ZstdCompressor(**plain)
        book = zstandard.ZstdCompressionDict(raw)
        book.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=book, **plain)

    def of(self, text: str | None) -> list[int]:
        """Bytes with the good dictionary, with the bad one, with none, and uncompressed."""
        parts = pieces(text)
        return [*(sum(map(len, map(p.compress, parts))) for p in self.packers), sum(map(len, parts))]


@functools.lru_cache(maxsize=4)
def sizes(good: bytes, bad: bytes) -> Sizes:
    """One set of compressors a worker process."""
    return Sizes(good, bad)


def differences(found: np.ndarray) -> np.ndarray:
    """Normalised differences of rows of four sizes, with their squares and a constant."""
    good, bad, none, raw = np.maximum(found.astype(float), 1).T
    by_other = np.clip(np.log(good / bad), -0.5, 0.5)
    by_length = np.clip((good - bad) / raw, -0.2, 0.2)
    to_plain = np.clip(np.log(none / raw), -3, 0.5)
    return np.stack([by_other, by_length, to_plain, by_other**2, by_other * by_length, by_length**2, to_plain**2, np.ones(len(good))], axis=1)


class Model:
    """The dictionaries and the curve."""

    def __init__(self, good: bytes, bad: bytes, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.good, self.bad, self.mean, self.spread, self.weights = good, bad, mean, spread, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        measure = sizes(self.good, self.bad)
        x = (differences(np.array([measure.of(t) for t in texts]).reshape(-1, 4)) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def calibrated(good: bytes, bad: bytes, found: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Model:
    """Fits the curve by Newton steps with a ridge on all but the intercept."""
    x = differences(found)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[-1], spread[-1] = 0, 1
    x = (x - mean) / spread
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return Model(good, bad, mean, spread, w)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece of the texts that dictionaries are built from."""
    for batch in batches:
        good: list[int] = []
        piece: list[bytes] = []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cut = pieces(text)
            good += [label] * len(cut)
            piece += cut
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(piece, pa.binary())], names=["good", "piece"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_pieces: int = TRAIN_PIECES) -> Model:
    """Learns from labelled rows that are not held out, at most train_rows of them (by a hash of doc_id).

    A document with several labels counts as good if one of them says so; labels other than 0 and 1 are left out. Half of the
    rows give the dictionaries, equal pieces once, at most train_pieces a label; the other half gives the curve. Where one
    label is missing in either half, every text gets the share of good rows.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    known = known.where(~held_out() & F.col("good").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most train_rows rows of two numbers, so they are sent to the texts.
    train = stored(texts.join(F.broadcast(known), "doc_id").select("text", "good", (F.xxhash64("doc_id", F.lit(11)) % 2 == 0).alias("book")))
    halves = {(r.book, r.good): r.n for r in train.groupBy("book", "good").agg(F.count("*").alias("n")).collect()}
    if len(halves) < 4:
        n = sum(halves.values())
        share = (sum(v for (_, good), v in halves.items() if good) + 0.5) / (n + 1)
        return Model(b"", b"", np.zeros(8), np.ones(8), np.r_[np.zeros(7), np.log(share / (1 - share))])
    cut = train.where("book").select("text", "good").mapInArrow(_pieces_of, "good int, piece binary").distinct()
    books = []
    for label in (1, 0):
        # train_pieces pieces of PIECE bytes at most.
        chosen = cut.where(F.col("good") == label).orderBy(F.xxhash64("piece"), "piece").limit(train_pieces).collect()
        books.append(dictionary([bytes(r.piece) for r in chosen]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sizes(*books).of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["good", "sizes"])

    rows = train.where("not book").select("text", "good").mapInArrow(run, "good int, sizes array<long>").collect()  # train_rows at most, but for repeated ids
    discard(train)
    return calibrated(*books, np.array([r.sizes for r in rows]), np.array([r.good for r in rows], float))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row per row; no shuffle.

    Null and empty texts are one empty piece and get its score. Rows without a doc_id are not held out; rows that repeat one
    are scored each. Very long texts are scored whole, piece by piece. There are no ties: equal texts get equal scores. Other
    columns are left out and never read; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
