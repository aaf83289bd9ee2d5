"""Phased scaffold files: a line `>chr pos ref alt id` a variant, then a line of signed ids a pair of haplotype rows.

A variant is two scaffolds of 1000 bases, numbers 2 id - 1 (reference) and 2 id (alternate). A line is two rows of the order:
one takes the reference of each positive id and the alternate of each negative one, the other its partner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.operators import scans as S

#: Fixed value: bases of a variant's scaffold.
LENGTH = 1000


def read_psf(spark: SparkSession, path: str) -> DataFrame:
    """Lines (at, value) of a file or folder, `at` telling their order in it however the file is split."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("at"))
    return lines.where(F.trim("value") != "")


def psf_scaffolds(lines: DataFrame) -> DataFrame:
    """(name, id, length): both scaffolds of each variant; lines of another form are left out."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.startswith("value", F.lit(">"))).select(t.alias("t"), F.get(t, 4).try_cast("long").alias("variant")).where("variant is not null")
    both = rows.select("t", "variant", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    place = F.substring(F.get("t", 0), 2, 1_000_000)
    return both.select(F.concat_ws(":", place, F.get("t", 1), F.get("t", F.col("k") + 2)).alias("name"), (2 * F.col("variant") - 1 + F.col("k")).alias("id"), F.lit(LENGTH).cast("long").alias("length"))


def psf_order(lines: DataFrame) -> DataFrame:
    """(grp, ord, signed_id, length): the haplotype rows, pair after pair, as an order of scaffolds."""
    rows = lines.where(~F.startswith("value", F.lit(">"))).select("at", F.split(F.trim("value"), r"\s+").cast("array<long>").alias("ids"))
    held = S.ranged(rows, [], ["at"])
    held = S.prefix(S.prefix(held, [], "pair", "sum", F.lit(1), False), [], "before", "sum", F.size("ids"), False)
    each = held.select("pair", "before", F.size("ids").alias("n"), F.posexplode("ids").alias("place", "v"))
    both = each.withColumn("other", F.explode(F.array(F.lit(0), F.lit(1))))
    reference = (F.col("v") > 0) == (F.col("other") == 0)
    return both.select(
        (2 * F.col("pair") + F.col("other") + 1).cast("long").alias("grp"),
        (2 * F.col("before") + F.col("other") * F.col("n") + F.col("place") + 1).cast("long").alias("ord"),
        F.when(reference, 2 * F.abs("v") - 1).otherwise(2 * F.abs("v")).alias("signed_id"), F.lit(LENGTH).cast("long").alias("length"),
    )


def psf_lines(scaffolds: DataFrame, order: DataFrame, name: str = "map.psf") -> DataFrame:
    """Rows (path, seq, content) of the file of phased scaffolds: variants by id, then every first row of a pair."""
    cut = F.split("name", ":")
    pairs = scaffolds.groupBy(F.expr("(id + 1) div 2").alias("variant")).agg(F.max(F.when(F.col("id") % 2 == 1, cut)).alias("a"), F.max(F.when(F.col("id") % 2 == 0, cut)).alias("b"))
    head = F.concat(F.lit(">"), F.concat_ws(" ", F.get("a", 0), F.get("a", 1), F.get("a", 2), F.get("b", 2), F.col("variant").cast("string")), F.lit("\n"))
    first = pairs.select(F.struct(F.lit(0).alias("k"), F.col("variant").alias("at")).alias("seq"), head.alias("content"))
    ids = F.sort_array(F.collect_list(F.struct("ord", F.expr("if(signed_id % 2 = 0, -(signed_id div 2), (signed_id + 1) div 2)").alias("v"))))
    rows = order.where("grp % 2 = 1").groupBy("grp").agg(F.array_join(F.transform(ids, lambda s: s.getField("v").cast("string")), " ").alias("line"))
    return first.unionByName(rows.select(F.struct(F.lit(1).alias("k"), F.col("grp").alias("at")).alias("seq"), F.concat("line", F.lit("\n")).alias("content"))).withColumn("path", F.lit(name))
