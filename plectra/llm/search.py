"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time over long ones.

Two passes. The first reads every text once and keeps, per document, its length and the counts of terms that a query
holds; document frequencies and totals are sums over that table. The second builds inverted lists of a segment of
documents at a time and ranks all queries against it. A query's short lists are summed term by term into accumulators.
These, sorted by document, become one more iterator with bounds, beside the long lists: a block of documents whose best
accumulator and best long impacts together stay under the tenth best score so far is skipped without a look at its
postings. The threshold starts with the tenth best accumulator, and a task carries it from segment to segment.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectra.llm.common import discard, small_batches, stored

#: Results of a query.
TOP = 10
#: (query, term) rows of one block of queries, whose terms and weights are sent to all tasks; more queries take more passes.
BLOCK_TERMS = 500_000
#: Postings of a segment, documents of a block, and the share of a segment's documents from which a list is long.
SEGMENT_POSTINGS, BLOCK, LONG = 2_000_000, 256, 1 / 16
#: Delimiters become blanks, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def query_terms(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """(item_id, term) of every query, each term once; queries without a term and without an id do not appear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t or b""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    plain = items.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("raw")).where("id is not null")
    return plain.mapInArrow(run, "item_id long, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()


def forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, terms array<int>, tfs array<int>) of documents with a term; terms of no query count in n alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(raw or b"")
                if words:
                    found = Counter(map(numbers.get, words))
                    found.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            made = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "terms", "tfs"])

    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Segment:
    """Inverted lists of some documents, in ascending order of doc_id, with exact impacts."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = 10 + (90 * lengths * documents) // total
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        by_term = np.lexsort((place[doc], terms))
        self.docs, self.impacts, terms = place[doc][by_term], impact[by_term], terms[by_term]
        self.edges = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.blocks = -(-len(ids) // BLOCK)
        self.least = LONG * len(ids)
        self.skips: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long(self, term: int) -> bool:
        return self.edges[term + 1] - self.edges[term] > self.least

    def skip(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a long list: where each block of documents begins, and each block's best impact."""
        if term not in self.skips:
            low, high = self.edges[term], self.edges[term + 1]
            edges = low + np.searchsorted(self.docs[low:high], np.arange(self.blocks + 1) * BLOCK)
            best = np.zeros(self.blocks, np.int64)
            filled = np.flatnonzero(edges[1:] > edges[:-1])
            if len(filled):
                best[filled] = np.maximum.reduceat(self.impacts[low:high], edges[filled] - low)
            self.skips[term] = edges, best
        return self.skips[term]

    def accumulated(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of short lists, ascending, and their summed impacts."""
        spans = [slice(self.edges[t], self.edges[t + 1]) for t in terms]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, where = np.unique(np.concatenate([self.docs[s] for s in spans]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, where, np.concatenate([self.impacts[s] for s in spans]))
        return docs, sums

    def ranked(self, terms: list[int], threshold: int, top: int) -> list[tuple[int, int]]:
        """(score, -doc_id) of documents that may be among the best `top`: all with a score over 0, from the threshold on."""
        longs = [t for t in terms if self.long(t)]
        docs, sums = self.accumulated([t for t in terms if not self.long(t)])
        if len(sums) >= top:
            threshold = max(threshold, int(np.partition(sums, -top)[-top]))
        if not longs:
            near = sums >= max(threshold, 1)
            return heapq.nlargest(top, zip(sums[near].tolist(), (-self.ids[docs[near]]).tolist(), strict=True))
        ends = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK)
        bound = np.zeros(self.blocks, np.int64)
        filled = np.flatnonzero(ends[1:] > ends[:-1])
        if len(filled):
            bound[filled] = np.maximum.reduceat(sums, ends[filled])
        skips = [self.skip(t) for t in longs]
        for _, best in skips:
            bound += best
        found: list[tuple[int, int]] = []
        for b in np.flatnonzero(bound >= max(threshold, 1)).tolist():
            if bound[b] < threshold:
                continue
            first = b * BLOCK
            scores = np.zeros(min(BLOCK, len(self.ids) - first), np.int64)
            scores[docs[ends[b] : ends[b + 1]] - first] = sums[ends[b] : ends[b + 1]]
            for edges, _ in skips:
                span = slice(edges[b], edges[b + 1])
                scores[self.docs[span] - first] += self.impacts[span]
            near = np.flatnonzero(scores >= max(threshold, 1))
            found = heapq.nlargest(top, [*found, *zip(scores[near].tolist(), (-self.ids[first + near]).tolist(), strict=True)])
            if len(found) == top:
                threshold = max(threshold, found[-1][0])
        return found


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Columns of some documents at a time, by their number of postings."""
    held: list[tuple] = []
    postings = documents = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists, counts = batch.column(2), batch.column(3)
        held.append((ids, batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), counts.flatten().to_numpy()))
        postings, documents = postings + len(held[-1][3]), documents + len(ids)
        if postings + documents >= SEGMENT_POSTINGS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, postings, documents = [], 0, 0
    if documents:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _search_block(docs: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """The best of each task for the queries of one block: (item_id, doc_id, score)."""
    # BLOCK_TERMS rows, give or take a hash's unevenness.
    rows = wanted.collect()
    numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    queries: dict[int, list[int]] = {}
    for r in rows:
        queries.setdefault(r.item_id, []).append(numbers[bytes(r.term)])
    index = stored(forward(docs, numbers))
    totals = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    weights = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a query term
        weights[r.t] = weight(totals.n, r.df)
    documents, length = totals.n, totals.l or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for ids, lengths, sizes, terms, tfs in _segments(batches):
            starts = np.concatenate([[0], np.cumsum(sizes)])
            segment = Segment(ids, lengths, starts, terms, tfs.astype(np.int64), weights, documents, length)
            for item, of in queries.items():
                before = best.get(item, [])
                threshold = before[-1][0] if len(before) == top else 0
                if found := segment.ranked(of, threshold, top):
                    best[item] = heapq.nlargest(top, [*before, *found])
        flat = [(item, -d, s) for item, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    return index.where("size(terms) > 0 and doc_id is not null").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> (item_id, rank, doc_id, score): the best documents of each item.

    Null and empty texts hold no term and are no documents of the collection; an item without a term, or whose terms no
    document holds, gives no row. Very long texts are read whole. Equal scores rank by doc_id; rows that repeat a doc_id count
    as documents each and are ranked each; rows without a doc_id count in all statistics but are not ranked. Repeated item
    rows count once; items of one id are one query. Other columns are left out; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    wanted = stored(query_terms(items))
    blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    found = [stored(_search_block(docs, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "term"), top)) for b in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    discard(wanted)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    # A task gives `top` rows a query at most, and the limit on the rank is applied before the shuffle as well.
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
dn AS (SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM dn) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), tot),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), tot GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
