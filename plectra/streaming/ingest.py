"""Pairs that arrive as text files, binned as they come: counts are additive, so a state is one row a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.operators import binning as B
from plectra.sources.pairs_text import parse_lines


def stream_pairs(spark: SparkSession, path: str, layout: int) -> DataFrame:
    """A streaming read of a folder of pair text with one layout; chromosome names must be indexes."""
    lines = spark.readStream.format("text").load(path)
    pairs = parse_lines(lines, layout)
    return pairs.withColumns({c: F.col(c).try_cast("long") for c in ("chr1", "chr2")}).where("chr1 is not null and chr2 is not null")


def stream_contacts(pairs: DataFrame, bin_size: int) -> DataFrame:
    """Running cell sums of one bin size, for update or complete output."""
    return B.binned(pairs, bin_size).groupBy(*B.KEYS).agg(F.sum("score").cast("double").alias("counts"))
