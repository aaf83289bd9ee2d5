"""Toxicity: a weighted finite-state grammar over clauses.

A lexicon turns each word into a symbol: one of four kinds of trigger (a given insult or threat, a learned stem
that is nearly or mostly found in toxic texts), target, negation, reporting verb, clause break or anything else. Three
small transducers annotate the symbols: negation holds for a few words, reported speech until the clause ends,
a target near a trigger. They are composed into one table, which a clause runs through; each trigger leaves a
matched pattern (kind, negated, reported, targeted). A document is scored by its matched patterns alone - which
occur, how often, and how often for its length - with weights fitted on labelled rows.

The given words are English. The lexicon of other languages, and what else marks an insult or threat, is learned
from the labelled rows as stems: whole words and beginnings of words, so that inflected forms count together. A
stem is learned if documents that use it, or use it heavily, are mostly toxic. Words that stand before triggers
are learned the same way: those found there mostly in clean texts act as negation, those mostly in toxic ones
as targets. Copies of a text count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm.common import small_batches, stored

#: Labelled rows that are fitted on at most (by a hash of doc_id).
TRAIN_ROWS = 20_000
#: Toxic documents (copies once) that a stem must occur in, or be used heavily in; the least part of the documents with it that
#: are toxic, also for a strong one; and how often toxic documents use it, as a multiple of how often others do.
OCCURS, HEAVY, PURE, STRONG, RATIO = 4, 3, 0.7, 0.95, 4.0
#: Lengths of beginnings of words, and the uses and the share of a text's words that make a use heavy.
SHORTEST, LONGEST = 4, 8
HEAVY_USES, HEAVY_SHARE, ONE_SHARE = 2, 0.004, 0.02
#: Documents in which a word must stand before a trigger to be learned as a target or as a negation.
CONTEXTS = 20
INSULT = "idiot moron stupid fool dumb loser scum trash pathetic worthless disgusting clown imbecile jerk"
THREAT = "kill hurt destroy murder beat punish stab shoot"
TARGET = "you your youre he she they him her them his their this that these those"
NEGATION = "not no never nor neither without isnt arent wasnt dont doesnt didnt"
REPORTING = "said says say wrote writes claimed claims called quoted reported alleged told"
OTHER, BREAK, NEG, REP, TGT, INS, THR, SURE, LIKELY = range(9)
SYMBOLS, KINDS, REACH = 9, 4, 4
#: Words whose symbols a worker remembers.
REMEMBERED = 200_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")

Transducer = tuple[int, dict[tuple[int, int], tuple[int, int]]]


def window_transducer(opens: int, width: int, until_break: bool) -> Transducer:
    """(states, table) that marks symbols for `width` words after `opens`, or until the clause ends."""
    table = {}
    for state, symbol in product(range(width + 1), range(SYMBOLS)):
        if symbol == BREAK:
            after = 0
        elif symbol == opens:
            after = width
        else:
            after = state if until_break else max(0, state - 1)
        table[state, symbol] = (after, int(state > 0))
    return width + 1, table


def composed(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """One table of all parts run side by side: next state, and the bits that they put out."""
    sizes = [n for n, _ in parts]
    states = list(product(*(range(n) for n in sizes)))
    number = {s: i for i, s in enumerate(states)}
    following = np.zeros((len(states), SYMBOLS), np.int32)
    bits = np.zeros((len(states), SYMBOLS), np.int32)
    for s, symbol in product(states, range(SYMBOLS)):
        steps = [table[x, symbol] for x, (_, table) in zip(s, parts, strict=True)]
        following[number[s], symbol] = number[tuple(a for a, _ in steps)]
        bits[number[s], symbol] = sum(b << i for i, (_, b) in enumerate(steps))
    return following, bits


#: Negation reaches four words, reported speech to the end of the clause, a target six words.
FOLLOWING, BITS = (x.tolist() for x in composed([window_transducer(NEG, REACH, False), window_transducer(REP, 1, True), window_transducer(TGT, 6, False)]))
#: Kinds of trigger by eight annotations.
PATTERNS = 8 * KINDS


class Lexicon:
    """The symbol of each word: given words first, then the longest learned stem that the word begins with."""

    def __init__(self, stems: dict[str, int], context: dict[str, int]):
        self.stems = stems
        self.fixed = dict(context)
        for words, symbol in ((INSULT, INS), (THREAT, THR), (TARGET, TGT), (NEGATION, NEG), (REPORTING, REP)):
            self.fixed |= dict.fromkeys(words.split(), symbol)
        self.fixed |= dict.fromkeys(".!?;\n", BREAK)
        self.known: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.fixed.get(word, -1)
            if found < 0:
                found = next((self.stems[x] for x in reversed(stems_of(word)) if x in self.stems), OTHER)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found


def stems_of(word: str) -> list[str]:
    """The beginnings of a word, and the word itself, by length."""
    return [*(word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)), word]


def matched(text: str, lexicon: Lexicon) -> tuple[list[int], int]:
    """Counts of the patterns in a text, and its number of words."""
    tokens = _TOKEN.findall(text.lower())
    counts, state, n = [0] * PATTERNS, 0, 0
    for symbol in map(lexicon.symbol, tokens):
        if symbol >= INS:
            counts[8 * (symbol - INS) + BITS[state][symbol]] += 1
        n += symbol != BREAK
        state = FOLLOWING[state][symbol]
    return counts, n


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    rate = counts / (words[:, None] + 20)
    return np.concatenate([counts > 0, np.log1p(counts), np.log1p(200 * rate), np.ones((len(counts), 1))], axis=1).astype(float)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton steps; the intercept is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest word hash of each text, which copies of a text share."""
    for batch in batches:
        own = [set(_WORD.findall((t or "").lower())) for t in batch.column(1).to_pylist()]
        copy = [min(map(xxhash.xxh3_64_intdigest, w)) >> 1 if w else 0 for w in own]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copy, pa.int64())], names=["id", "text", "toxic", "copy"])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stem and batch: documents that use it and use it heavily, toxic and not."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall((text or "").lower())
            uses: Counter[str] = Counter()
            for word, c in Counter(words).items():
                for stem in stems_of(word):
                    uses[stem] += c
            for stem, c in uses.items():
                share = c / len(words)
                row = seen.setdefault(stem, [0, 0, 0, 0])
                row[label] += 1
                row[2 + label] += (c >= HEAVY_USES and share >= HEAVY_SHARE) or share >= ONE_SHARE
        columns = [pa.array([r[i] for r in seen.values()], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *columns], names=["stem", "used0", "used1", "heavy0", "heavy1"])


def _contexts(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document and word of no symbol that stands up to REACH words before a trigger."""
        for batch in batches:
            words: list[str] = []
            toxic: list[int] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near: set[str] = set()
                tokens = _TOKEN.findall((text or "").lower())
                symbols = list(map(lexicon.symbol, tokens))
                for i, symbol in enumerate(symbols):
                    if symbol >= INS:
                        for k in range(i - 1, max(i - REACH, 0) - 1, -1):
                            if symbols[k] == BREAK:
                                break
                            if symbols[k] == OTHER:
                                near.add(tokens[k])
                words += near
                toxic += [label] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"])

    return run


def _counted(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matched(t or "", lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], names=["toxic", "counts", "n"]
            )

    return run


class Model:
    """What is learned: the lexicon and the weights of patterns."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon = lexicon
        self.weights = weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [matched(t or "", self.lexicon) for t in texts]
        counts = np.array([c for c, _ in found], float).reshape(-1, PATTERNS)
        x = features(counts, np.array([n for _, n in found], float))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learned_stems(texts: DataFrame, toxic: int, clean: int) -> dict[str, int]:
    """The symbol of each learned stem; longer ones that say the same as one of their beginnings are left out."""
    sums = [F.sum(c).alias(c) for c in ("used0", "used1", "heavy0", "heavy1")]
    seen = texts.select("text", "toxic").mapInArrow(_evidence, "stem string, used0 long, used1 long, heavy0 long, heavy1 long").groupBy("stem").agg(*sums)

    def telling(kind: str, least: int) -> F.Column:
        one, other = F.col(f"{kind}1"), F.col(f"{kind}0")
        often = (one + 0.5) / (toxic + 1) >= RATIO * (other + 0.5) / (clean + 1)
        return (one >= least) & (one >= PURE * (one + other)) & often

    strong = F.col("used1") >= STRONG * (F.col("used0") + F.col("used1"))
    found = seen.where(telling("used", OCCURS) | telling("heavy", HEAVY)).select("stem", F.when(strong, SURE).otherwise(LIKELY).alias("symbol"))
    # Each of these is in OCCURS or HEAVY of at most TRAIN_ROWS texts, so their number is bounded.
    every = {r.stem: r.symbol for r in found.collect()}
    return {s: k for s, k in every.items() if all(every.get(x, k) != k or x not in every for x in stems_of(s)[:-1])}


def learned_context(texts: DataFrame, lexicon: Lexicon) -> dict[str, int]:
    """Words before triggers that tell toxic uses from others: targets and negations."""
    rows = texts.select("text", "toxic").mapInArrow(_contexts(lexicon), "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("one"), F.sum(1 - F.col("toxic")).alias("other"))
    total = rows.agg(F.sum("one").alias("one"), F.sum("other").alias("other")).first()
    if not total.one or not total.other:
        return {}
    ratio = ((F.col("one") + 0.5) / (total.one + 1)) / ((F.col("other") + 0.5) / (total.other + 1))
    kind = F.when(ratio >= RATIO, TGT).when(ratio * RATIO <= 1, NEG)
    return {r.word: r.kind for r in rows.where(F.col("one") + F.col("other") >= CONTEXTS).select("word", kind.alias("kind")).where("kind is not null").collect()}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that are not held out, at most train_rows of them."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most train_rows rows of two numbers, so they are sent to the texts.
    train = stored(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_copies, "id long, text string, toxic int, copy long"))
    firsts = train.groupBy("copy", "toxic").agg(F.min("id").alias("id"))
    once = train.join(F.broadcast(firsts), ["copy", "toxic", "id"], "left_semi")
    sizes = {r.toxic: r.n for r in firsts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = 0.5 if not sizes else float(bool(sizes.get(1)))
        return Model(Lexicon({}, {}), np.r_[np.zeros(3 * PATTERNS), np.log((share + 0.01) / (1.01 - share))])
    stems = learned_stems(once, sizes[1], sizes[0])
    lexicon = Lexicon(stems, learned_context(once, Lexicon(stems, {})))
    rows = train.select("text", "toxic").mapInArrow(_counted(lexicon), "toxic int, counts array<long>, n long").collect()  # train_rows at most, but for repeated ids
    x = features(np.array([r.counts for r in rows], float), np.array([r.n for r in rows], float))
    return Model(lexicon, fitted(x, np.array([r.toxic for r in rows], float)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row per row; no shuffle.

    Null and empty texts get the score of a text without matches. Rows without a doc_id are not held out; rows
    that repeat one are scored each. Very long texts are scored whole, with nothing kept per word. There are no ties:
    equal texts get equal scores. Other columns are left out and never read; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
