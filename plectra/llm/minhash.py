"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct five-word shingles (ASCII letters lower-cased, words split at ASCII
white space; fewer than five words: the whole sequence is one shingle). Documents are linked at a Jaccard
similarity of 0.75 or more, and a component is what links connect.

1. Equal sets form one class, represented by its smallest doc_id.
2. Each class gets 200 MinHash samples, cut into 40 bands of five; classes that share a band are candidates.
   At a similarity of 0.75 a pair misses every band with probability (1 - 0.75**5)**40 = 2e-5.
3. The samples are folded into a 512-bit odd sketch. The population count of the XOR of two sketches
   estimates how many samples differ; only pairs whose estimate is clearly under the threshold are dropped
   (more than five standard deviations), the others are confirmed on their full sets.
4. No bucket is expanded into all pairs: every member is compared with the bucket's busiest member, then,
   where the other members still lie in different components, with a random one of them, a few times.
   What is then still torn is finished exactly, so that no link between different texts is lost: pairs of
   different components in buckets of a few members, and comparisons of blocks of members, inside tasks
   that only give links, for larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.llm.common import components, discard, released, small_batches, stored

WORDS, SAMPLES, BAND, SKETCH_BITS = 5, 200, 5, 512
#: Differing sketch bits above which a pair's similarity is taken to be under 0.55.
SKETCH_MOST = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * 0.45) / SKETCH_BITS)))
#: Turns with random centres, and members of a bucket that is still paired directly after them.
TURNS, SMALL = 1, 8
#: Shingles meant for a block of the exact finish, and bits of the bitmap of candidate documents (16 MB).
BLOCK, ID_BITS = 1_000_000, 1 << 27
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MIX = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x9E3779B97F4A7C15 ** (i + 1) % 2**64 | 1 for i in range(WORDS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that sums of word hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * _STEP[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * _STEP[i]
    return np.unique(_mixed(total))


def samples(found: np.ndarray) -> np.ndarray:
    """The smallest permuted value of each of SAMPLES permutations, over a non-empty set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):  # blocks that stay in the processor's cache
        block = (low[at : at + 512, None] ^ _XOR) * _MUL
        np.minimum(out, block.min(axis=0), out=out)
    return out


def sketch_of(low: np.ndarray) -> np.ndarray:
    """Odd sketch: each sample flips one bit."""
    spread = _mixed((low.astype(np.uint64) + np.uint64(1)) * _MIX)
    bits = np.bincount((spread >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bands_of(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, BAND).astype(np.uint64)
    total = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(BAND):
        total = _mixed(total + rows[:, i] * _STEP[i])
    return total.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        n, k1, k2, bands, sketch = [], [], [], [], []
        for text in texts:
            found = shingles(text or b"")
            n.append(len(found))
            if len(found):
                key = xxhash.xxh3_128_digest(found.tobytes())
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                low = samples(found)
                bands.append(bands_of(low))
                sketch.append(sketch_of(low))
            else:
                for column in (k1, k2, bands, sketch):
                    column.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
            names=["id", "n", "k1", "k2", "bands", "sketch"],
        )


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = [shingles(t or b"").view(np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])


def _sketch_near() -> F.Column:
    bits = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return bits <= SKETCH_MOST


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose odd sketches do not rule a link out."""
    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_sketch_near()).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= 75 * union, on full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    union = F.size("xa") + F.size("xb") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= 75 * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _block_links(length_cap: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components in two blocks of members: sketches first, then intersections of bit rows."""
        rows = rows.sort_values("id", kind="stable")
        ids, roots, side = (rows[c].to_numpy() for c in ("id", "root", "side"))
        sets = [np.asarray(x) for x in rows["set"]]
        sketch = np.stack([np.asarray(x) for x in rows["sketch"]]).view(np.uint64)
        size = np.array([len(x) for x in sets])
        values, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        width = -(-int((times > 1).sum()) // 64)
        table = None
        if width * len(ids) <= length_cap:
            packed = np.zeros((len(ids), width), np.uint64)
            at = 0
            for i, n in enumerate(size):
                mine = back[at : at + n]
                mine = column[mine[times[mine] > 1]]
                np.bitwise_or.at(packed[i], mine >> 6, np.uint64(1) << (mine & 63).astype(np.uint64))
                at += n
            table = packed
        out: set[tuple[int, int]] = set()
        both = len(np.unique(side)) > 1
        for i in range(len(ids)):
            other = (roots != roots[i]) & (np.arange(len(ids)) > i) & (4 * np.minimum(size, size[i]) >= 3 * np.maximum(size, size[i]))
            if both:
                other &= side != side[i]
            near = np.flatnonzero(other)
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= SKETCH_MOST]
            if not len(near):
                continue
            if table is not None:
                common = np.bitwise_count(table[near] & table[i]).sum(axis=1).astype(np.int64)
            else:
                common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near])
            good = near[100 * common >= 75 * (size[i] + size[near] - common)]
            for root in np.unique(roots[good]):  # one link between a document and a component is enough
                out.add((int(ids[i]), int(ids[good[roots[good] == root][0]])))
        return pd.DataFrame(sorted(out), columns=["u", "v"], dtype="int64")

    return run


def _torn_links(torn: DataFrame, plain: DataFrame, sketches: DataFrame) -> DataFrame:
    """Every link between components inside clusters of torn buckets, in pairs of bounded blocks.

    Buckets that share a member form a cluster. Its members are dealt into blocks of about BLOCK shingles, those
    of its largest component apart from the rest, and each pair of blocks, but for two of the largest
    component, is compared in one task. Links alone leave it, one a document and component at most.
    """
    centre = torn.groupBy("key").agg(F.min("id").alias("c"))
    cluster = components(torn.join(centre, "key").select(F.col("id").alias("u"), F.col("c").alias("v")))
    ids = stored(torn.select("id", "root").distinct().join(cluster.select(F.col("node").alias("id"), F.col("root").alias("g")), "id"))
    full = _full_sets(plain, ids.select("id")).join(ids, "id").join(sketches, "id")
    counts = stored(full.groupBy("g", "root").agg(F.sum(F.size("set")).alias("n")))
    large = counts.groupBy("g").agg(F.max(F.struct("n", "root")).alias("x")).select("g", F.col("x.root").alias("largest"))
    flagged = counts.join(large, "g").withColumn("rest", (F.col("root") != F.col("largest")).cast("int"))
    sizes = flagged.groupBy("g", "largest").agg(
        *(F.ceil(F.sum(F.when(F.col("rest") == f, F.col("n")).otherwise(0)) / BLOCK).cast("int").alias(f"b{f}") for f in (0, 1))
    )
    placed = full.join(sizes, "g").withColumn("rest", (F.col("root") != F.col("largest")).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("rest") == 1, F.col("b1")).otherwise(F.col("b0"))).cast("int") + F.when(F.col("rest") == 1, F.col("b0")).otherwise(0)
    first = F.when(F.col("rest") == 1, F.lit(0)).otherwise(F.col("b0"))
    partners = F.sequence(first, F.col("b0") + F.col("b1") - 1)
    dealt = placed.withColumn("side", own).withColumn("partner", F.explode(partners))
    dealt = dealt.select("g", F.least("side", "partner").alias("i"), F.greatest("side", "partner").alias("j"), "id", "root", "side", "set", "sketch")
    return dealt.groupBy("g", "i", "j").applyInPandas(_block_links(1 << 24), "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id long, text, ...) -> (doc_id, n_shingles long, component_id long, kept boolean), a row per row.

    Null, empty and word-less texts have no shingles and are linked with nothing. Rows without a doc_id take
    no part in linking: component_id null, kept true. Rows that repeat a doc_id count as one document.
    Other columns, whatever their names, are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = "id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"
    feats = stored(plain.mapInArrow(_features, schema), "lz4")
    one = F.min_by(F.struct("id", "bands", "sketch"), "id").alias("x")
    reps = stored(feats.where("n > 0 and id is not null").groupBy("k1", "k2").agg(one).select("k1", "k2", "x.*"), "lz4")
    classes = reps.select("k1", "k2", F.col("id").alias("rep"))
    sketches = reps.select("id", "sketch")
    around, links = _starred(reps, plain, sketches)
    found = components(links)
    for turn in range(TURNS):
        torn = _torn(around, found)
        if torn.isEmpty():
            break
        pick = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "root")).alias("x")
        centres = torn.groupBy("key").agg(pick).select("key", F.col("x.id").alias("a"), F.col("x.root").alias("r"))
        pairs = torn.join(centres, "key").where("root <> r").select("a", F.col("id").alias("b")).distinct()
        links = stored(links.union(_linked(pairs, plain, sketches)))
        found = components(links)
    else:
        torn = _torn(around, found)
    if not torn.isEmpty():
        sizes = torn.groupBy("key").agg(F.count("*").alias("m"))
        torn = stored(torn.join(sizes, "key"))
        small = torn.where(F.col("m") <= SMALL)
        left = small.select("key", F.col("id").alias("a"), F.col("root").alias("ra"))
        right = small.select("key", F.col("id").alias("b"), F.col("root").alias("rb"))
        pairs = left.join(right, "key").where("a < b and ra <> rb").select("a", "b")
        links = links.union(_linked(pairs.distinct(), plain, sketches))
        wide = torn.where(F.col("m") > SMALL).select("key", "id", "root")
        if not wide.isEmpty():
            links = links.union(_torn_links(wide, plain, sketches))
        links = stored(links)
        found = components(links)
    # Components of classes, named by their smallest document.
    least = found.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("component"))
    named = found.join(least, "root").select(F.col("node").alias("rep"), "component")
    lookup = classes.join(named, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return feats.join(lookup, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def _starred(reps: DataFrame, plain: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id) of each bucket's members but its busiest, and the links found between these and the busiest."""
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    members = stored(rows.join(shared.select("key", "c"), "key"))
    busy = members.groupBy("id").agg(F.sum("c").alias("w"))
    order = F.struct("w", (-F.col("id")).alias("order"), "id")
    centres = members.join(busy, "id").groupBy("key").agg(F.max(order).getField("id").alias("centre"))
    around = stored(members.select("key", "id").join(centres, "key").where("id <> centre"))
    pairs = around.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = _linked(pairs, plain, sketches)
    discard(members)
    return around.select("key", "id"), links


def _torn(around: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, root) of buckets whose members, the centre aside, lie in several components."""
    roots = found.select(F.col("node").alias("id"), "root")
    rooted = around.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return stored(rooted.join(split.select("key"), "key"))


def _linked(pairs: DataFrame, plain: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (u, v) among candidate pairs (a, b): odd sketches first, then full sets."""
    likely = stored(_likely(pairs, sketches))
    sets = _full_sets(plain, likely.select(F.explode(F.array("a", "b")).alias("id")))
    links = stored(_confirmed(likely, sets))
    discard(likely, sets)
    released(plain.sparkSession)
    return links


def _full_sets(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents with these ids, and a few others.

    The ids go to the tasks as a bitmap of their hashes, which has a fixed size, so no text is shuffled;
    documents that only share a bit fall away in the joins that follow.
    """
    spark = plain.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    maps = ids.groupBy(F.bitmap_bucket_number(place + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("m"))
    bits = np.zeros(ID_BITS // 8, np.uint8)
    for row in maps.collect():  # ID_BITS bits at most
        bits[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    wanted = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            own = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(own):
                yield from _sets([batch.select([0, 1]).take(pa.array(own))])

    marked = plain.where("id is not null").select("id", "text", place.alias("place"))
    out = stored(marked.mapInArrow(run, "id long, set array<long>").dropDuplicates(["id", "set"]), "lz4")
    wanted.destroy()  # else every worker keeps it
    return out


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
