"""Sharding by extendible hashing, with DataFrame functions alone.

A document's hash is 60 bits of an MD5 over its id and text. A bucket is a hash prefix; starting from the
empty prefix, a bucket over the byte limit is split on its next bit, and only such a bucket. Sizes are summed
once for prefixes a few bits longer than an even split needs and rolled up to all shorter ones, so the tree
is known without a pass for each bit; only prefixes that are still too large are summed again, deeper.
Identical rows, which no bit separates, are dealt into numbered parts of a prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectra.llm.common import stored

#: Bytes of text that a shard may hold; bits of the hash; bits beyond an even split, and bits more in each further pass.
LIMIT, HASH_BITS, BEYOND, DEEPER = 16 << 20, 60, 6, 12


def _prefix(depth) -> F.Column:
    return F.expr(f"shiftright(h, {HASH_BITS} - {depth})")


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, shard string, depth, part, shard_bytes), a row per row.

    shard: the bucket's prefix bits; depth: how many; part: 0, or the number of a part where identical rows
    overflow a whole hash. A null text has no bytes; rows without a doc_id are hashed by their text alone.
    A single row over the limit is a shard of its own. Other columns are left out; an empty table gives none.
    """
    text = F.coalesce(F.md5("text"), F.lit(""))
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(name, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )
    rows = stored(rows)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    top = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + BEYOND)
    open_, leaves, base = rows.select("h", "n_bytes"), [], 0
    while True:
        sums = stored(open_.groupBy(_prefix(top).alias("p")).agg(F.sum("n_bytes").alias("b")))
        steps = sums.select("p", "b", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        steps = steps.withColumn("q", F.expr(f"shiftright(p, {top} - depth)"))
        nodes = steps.groupBy("depth", "q").agg(F.sum("b").alias("shard_bytes"))
        fits = F.col("shard_bytes") <= limit
        fits = fits | (F.col("depth") == HASH_BITS) if top == HASH_BITS else fits
        chosen = steps.select("p", "depth", "q").join(nodes.where(fits), ["depth", "q"])
        found = stored(chosen.groupBy("p").agg(F.min(F.struct("depth", "q", "shard_bytes")).alias("x")).select("p", F.lit(top).alias("top"), "x.*"))
        leaves.append((top, found))
        rest = sums.join(found, "p", "left_anti").select("p")
        if top == HASH_BITS or rest.isEmpty():
            break
        open_ = stored(open_.withColumn("p", _prefix(top)).join(rest, "p", "left_semi").select("h", "n_bytes"))
        base, top = top + 1, min(HASH_BITS, top + DEEPER)
    out = None
    for top, found in leaves:
        here = rows.withColumn("p", _prefix(top)).join(found, "p").select("doc_id", "n_bytes", "h", "depth", "q", "shard_bytes")
        out = here if out is None else out.union(here)
    out = _parts(out, limit)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(cast(q as string), 10, 2), depth, '0')"))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), "depth", "part", "shard_bytes")


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Numbers the parts of buckets that hold one hash only and are too large, without gathering them."""
    plain = rows.where(f"shard_bytes <= {limit}").withColumn("part", F.lit(0).cast("long"))
    large = rows.where(f"shard_bytes > {limit}")
    if large.isEmpty():
        return plain
    large = stored(large).withColumn("pid", F.spark_partition_id())
    order = Window.partitionBy("h", "pid").orderBy("doc_id")
    large = stored(large.withColumn("k", F.row_number().over(order)))
    counts = large.groupBy("h", "pid").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("h").orderBy("pid")) - F.col("c"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    numbered = large.join(before.drop("c"), ["h", "pid"]).withColumn("part", F.expr("k + before - 1").cast("long"))
    numbered = numbered.withColumn("part", F.floor(F.col("part") / each)).drop("pid", "k", "before")
    sizes = numbered.groupBy("h", "part").agg(F.sum("n_bytes").alias("part_bytes"))
    numbered = numbered.join(sizes, ["h", "part"]).select("doc_id", "n_bytes", "h", "depth", "q", F.col("part_bytes").alias("shard_bytes"), "part")
    return plain.union(numbered)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
k AS (SELECT CAST(unnest(range(0, {HASH_BITS} + 1)) AS INT) AS depth),
n AS (SELECT depth, h >> ({HASH_BITS} - depth) AS q, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM r, k GROUP BY ALL
      HAVING sum(n_bytes) <= {LIMIT} OR depth = {HASH_BITS}),
f AS (SELECT doc_id, n_bytes, h, n.depth, q, shard_bytes FROM r, k, n WHERE n.depth = k.depth AND q = h >> ({HASH_BITS} - k.depth)
      QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY n.depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(q), depth, '0') END AS shard, depth, CAST(0 AS BIGINT) AS part, shard_bytes
FROM f
"""
