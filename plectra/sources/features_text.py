"""Text tables: chromosome sizes, sites, intervals, rectangles, motifs, genes, scaffolds, vectors, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_chromosome(name: Column) -> Column:
    """Lower case without 'chr'; MT is M."""
    short = F.regexp_replace(F.lower(name), "^chr", "")
    return F.when(short == "mt", "m").otherwise(short)


def _tokens(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    text = F.trim(F.col("value"))
    return lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(F.split(text, sep).alias("t"))


def _long(at: int) -> Column:
    return F.get("t", at).try_cast("long")


def parse_sizes(lines: DataFrame) -> DataFrame:
    """name<TAB>length -> (name, len)."""
    return _tokens(lines).select(F.get("t", 0).alias("name"), _long(1).alias("len")).where("len is not null")


def parse_sites(lines: DataFrame) -> DataFrame:
    """chr site1 site2 ... -> (chr, site_idx, pos); a site that is no number has no position."""
    rows = _tokens(lines).select(F.get("t", 0).alias("chr"), F.posexplode(F.slice("t", 2, F.size("t"))).alias("site_idx", "pos"))
    return rows.select("chr", F.col("site_idx").cast("long").alias("site_idx"), F.col("pos").try_cast("long").alias("pos"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """First three columns of lines that start with chr; distinct."""
    rows = _tokens(lines.where(F.startswith("value", F.lit("chr"))))
    return rows.select(F.get("t", 0).alias("chr"), _long(1).alias("x1"), _long(2).alias("x2")).dropDuplicates()


def parse_bedpe(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Six coordinates; name, score, strands and colour where present; columns from the 12th as attributes by header name."""
    rows = _tokens(lines, r"\t").where((F.size("t") >= 6) & _long(1).isNotNull())
    extra = F.create_map(*(x for i, n in enumerate(header or []) if i >= 11 for x in (F.lit(n), F.get("t", i)))) if header and len(header) > 11 else F.create_map().cast("map<string,string>")
    return rows.select(
        F.get("t", 0).alias("chr1"), _long(1).alias("start1"), _long(2).alias("end1"), F.get("t", 3).alias("chr2"), _long(4).alias("start2"), _long(5).alias("end2"), F.get("t", 10).alias("color"), extra.alias("attributes")
    )


def parse_domains(lines: DataFrame) -> DataFrame:
    """chr start end -> a square on the diagonal."""
    rows = _tokens(lines).where(_long(1).isNotNull())
    return rows.select(F.get("t", 0).alias("chr1"), _long(1).alias("start1"), _long(2).alias("end1"), F.get("t", 0).alias("chr2"), _long(1).alias("start2"), _long(2).alias("end2"))


def parse_loops(lines: DataFrame, header: list[str]) -> DataFrame:
    """Legacy loops: six coordinates, colour, attributes by header name from the eighth column."""
    rows = _tokens(lines, r"\t").where((F.size("t") >= 6) & _long(1).isNotNull())
    extra = F.create_map(*(x for i, n in enumerate(header) if i >= 7 for x in (F.lit(n), F.get("t", i))))
    return rows.select(F.get("t", 0).alias("chr1"), _long(1).alias("start1"), _long(2).alias("end1"), F.get("t", 3).alias("chr2"), _long(4).alias("start2"), _long(5).alias("end2"), F.get("t", 6).alias("color"), extra.alias("attributes"))


def parse_motifs(lines: DataFrame) -> DataFrame:
    """Nine columns (pattern, sequence name, start, stop, strand, score, p, q, sequence); a name chr:a-b shifts both ends by a."""
    rows = _tokens(lines, r"\t").where((F.size("t") >= 9) & _long(2).isNotNull())
    name = F.get("t", 1)
    shift = F.coalesce(F.regexp_extract(name, r":(\d+)-", 1).try_cast("long"), F.lit(0))
    return rows.select(
        F.regexp_extract(name, "^([^:]+)", 1).alias("chr"), (_long(2) + shift).alias("x1"), (_long(3) + shift).alias("x2"), (F.get("t", 4) == "+").alias("strand"),
        *(F.get("t", i).try_cast("double").alias(n) for i, n in ((5, "score"), (6, "p"), (7, "q"))), F.get("t", 8).alias("sequence"),
    )


def parse_genes(lines: DataFrame) -> DataFrame:
    """Four columns (name chr start end, ends moved in by one) or sixteen (name 12, chr 2, start 4, end 5)."""
    rows = _tokens(lines)
    wide = F.size("t") >= 16
    return rows.select(
        F.when(wide, F.get("t", 12)).otherwise(F.get("t", 0)).alias("name"),
        F.when(wide, F.get("t", 2)).otherwise(F.get("t", 1)).alias("chr"),
        F.when(wide, _long(4)).otherwise(_long(2) + 1).alias("x1"),
        F.when(wide, _long(5)).otherwise(_long(3) - 1).alias("x2"),
    ).where("x1 is not null and x2 is not null")


def parse_triples(lines: DataFrame) -> DataFrame:
    """binX binY count."""
    return _tokens(lines).select(_long(0).alias("bin_x"), _long(1).alias("bin_y"), F.get("t", 2).try_cast("double").alias("counts")).where("counts is not null")


def parse_scaffolds(lines: DataFrame) -> DataFrame:
    """'>name id length' lines with their running start; ids are in file order."""
    rows = _tokens(lines.where(F.startswith("value", F.lit(">")))).select(F.substring(F.get("t", 0), 2, 1_000_000).alias("name"), _long(1).alias("id"), _long(2).alias("length"))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("orig_start", F.coalesce(F.sum("length").over(before), F.lit(0)) + 1)


def parse_wig(lines: DataFrame, chr_name: str, start: int, step: int) -> DataFrame:
    """The values of one fixedStep block; needs (line, value) rows."""
    rows = lines.select(F.col("line").cast("long").alias("k"), F.col("value").try_cast("double").alias("v")).where("v is not null")
    at = F.lit(start) + F.col("k") * step
    return rows.select(F.lit(chr_name).alias("chr"), at.alias("start"), (at + step).alias("end"), F.col("v").alias("value"))


def parse_wig_files(lines: DataFrame) -> DataFrame:
    """(chr, start, end, value) of fixedStep and variableStep blocks; needs (file, line, value) rows.

    A block's header holds for the lines up to the next one, so the rows of a file are ordered by line in one
    task; several files run side by side. A step and a span that are not given are 1. Positions are from 1 in the
    file and from 0 here; lines that are no number are passed over.
    """
    order = Window.partitionBy("file").orderBy("line")
    text = F.trim("value")
    head = F.when(F.startswith(text, F.lit("fixedStep")) | F.startswith(text, F.lit("variableStep")), text)
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & ~F.startswith(text, F.lit("track"))).select("file", "line", text.alias("t"), head.alias("own"))
    held = rows.withColumns({"head": F.last("own", ignorenulls=True).over(order), "block": F.count("own").over(order)})
    k = F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 2
    field = lambda name: F.regexp_extract("head", rf"\b{name}=(\S+)", 1)
    number = lambda name: F.coalesce(field(name).try_cast("long"), F.lit(1))
    part = F.split("t", r"\s+")
    fixed = F.startswith("head", F.lit("fixedStep"))
    start = F.when(fixed, number("start") + k * number("step")).otherwise(F.get(part, 0).try_cast("long")) - 1
    value = F.get(part, F.when(fixed, 0).otherwise(1)).try_cast("double")
    found = held.select("own", field("chrom").alias("chr"), start.alias("start"), (start + number("span")).alias("end"), value.alias("value"))
    return found.where("own is null and start is not null and value is not null").drop("own")


def tab_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as tab-separated text, the way every text sink here writes them."""
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))


def triples_text(cells: DataFrame) -> DataFrame:
    """x<TAB>y<TAB>v with bin-start coordinates."""
    out = cells.select((F.col("bin_x") * F.col("bin_size")).alias("x"), (F.col("bin_y") * F.col("bin_size")).alias("y"), F.col("counts").cast("decimal(20,2)").alias("v"))
    return tab_lines(out, ["x", "y", "v"])
