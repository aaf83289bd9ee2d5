"""Read-pair text: the layout follows from the number of columns, or from a #columns header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_MAPQ = 1000
SCHEMA = ("strand1", "chr1", "pos1", "frag1", "mapq1", "seq1", "strand2", "chr2", "pos2", "frag2", "mapq2", "seq2", "score")
#: Token of each field, from 0, by number of columns.
LAYOUTS: dict[int, dict[str, int]] = {
    4: {"chr1": 0, "pos1": 1, "chr2": 2, "pos2": 3},
    5: {"chr1": 0, "pos1": 1, "chr2": 2, "pos2": 3, "score": 4},
    8: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7},
    9: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7, "score": 8},
    11: {"strand1": 1, "chr1": 2, "pos1": 3, "frag1": 4, "strand2": 5, "chr2": 6, "pos2": 7, "frag2": 8, "mapq1": 9, "mapq2": 10},
    16: {"strand1": 0, "chr1": 1, "pos1": 2, "frag1": 3, "strand2": 4, "chr2": 5, "pos2": 6, "frag2": 7, "mapq1": 8, "seq1": 10, "mapq2": 11, "seq2": 13},
}


def _value(tokens: Column, layout: dict[str, int], field: str) -> Column:
    at = layout.get(field)
    raw = F.get(tokens, at) if at is not None else F.lit(None).cast("string")
    if field.startswith("strand"):
        return F.coalesce(raw.isin("0", "+"), F.lit(True))
    if field.startswith(("pos", "frag")):
        default = {"frag1": 0, "frag2": 1}.get(field)
        return F.coalesce(raw.try_cast("long"), F.lit(default).cast("long"))
    if field.startswith("mapq"):
        return F.coalesce(raw.try_cast("long"), F.lit(NO_MAPQ).cast("long"))
    if field == "score":
        return F.coalesce(raw.try_cast("double"), F.lit(1.0))
    return raw


def parse_lines(lines: DataFrame, layout: dict[str, int] | int, column: str = "value") -> DataFrame:
    """Rows of one layout; header and empty lines go, fields that a layout lacks get their defaults."""
    layout = LAYOUTS[layout] if isinstance(layout, int) else layout
    text = F.trim(F.col(column))
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(F.split(text, r"\s+").alias("t"))
    return rows.select(*(_value(F.col("t"), layout, f).alias(f) for f in SCHEMA))


def dcic_layout(header: str) -> dict[str, int]:
    """Layout of a '#columns: readID chr1 pos1 ...' line."""
    names = header.split(":", 1)[1].split()
    known = {"chrom1": "chr1", "chrom2": "chr2"} | {f: f for f in SCHEMA}
    return {known[n]: i for i, n in enumerate(names) if n in known}


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Text files or a folder; a `#columns` line, wherever it stands, tells the layout, else the number of columns of the first pair.

    Comments and empty lines may come before the first pair in any number. Without a pair there are no rows.
    """
    lines = spark.read.text(path)
    columns = lines.where(F.startswith("value", F.lit("#columns"))).first()
    if columns:
        return parse_lines(lines, dcic_layout(columns.value))
    first = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).first()
    if first is None:
        return parse_lines(lines, LAYOUTS[4])
    n = len(first.value.split())
    if n not in LAYOUTS:
        raise ValueError(f"no layout of pairs has {n} columns")
    return parse_lines(lines, LAYOUTS[n])


def to_lines(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs as text of a layout with n columns; the read name of 11 columns is the row's hash."""
    names = {v: k for k, v in LAYOUTS[n].items()}

    def text(field: str | None) -> Column:
        if field is None:
            return F.lit("x")
        if field.startswith("strand"):
            return F.when(F.col(field), "0").otherwise("16")
        return F.col(field).cast("string") if field in pairs.columns else F.lit("1" if field == "score" else "0")

    return pairs.select(F.concat_ws(" ", *(text(names.get(i)) for i in range(n))).alias("value"))
