"""URL filters against dated lists: a temporal join, with DataFrame functions alone.

A list is a log of dated entries: a pattern (a host, or a domain that stands for all hosts below it) is added
with a verdict, or removed. Each pattern's entries become disjoint validity intervals [from, to). A capture is
judged by the entry that was active when it was fetched: of the host's patterns with an open interval, the
longest. Captures are first reduced to distinct (host, day) pairs, so a host with a third of all captures
costs as many rows as it has days, and neither side of the as-of join has a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: F.Column) -> F.Column:
    """Lower-case host without user, port or trailing dot; null where the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """entries(pattern, day date, action 'add'|'remove', verdict) -> (pattern, valid_from, valid_to, verdict).

    Entries of one pattern and day count once: a removal wins over an addition, then the smaller verdict.
    Rows without a pattern or day are left out; an addition without an end is valid until {FOREVER}.
    """
    one = entries.where("pattern is not null and day is not null").groupBy(F.lower("pattern").alias("pattern"), "day").agg(
        F.max((F.col("action") == "remove").cast("int")).alias("gone"), F.min(F.when(F.col("action") == "add", F.col("verdict"))).alias("verdict")
    )
    later = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    spans = one.withColumn("valid_to", F.coalesce(later, F.to_date(F.lit(FOREVER))))
    return spans.where("gone = 0").select("pattern", F.col("day").alias("valid_from"), "valid_to", "verdict")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched date, ...) -> (page_id, host, fetched, pattern, valid_from, verdict), a row per row.

    verdict is 'none' (pattern and valid_from null) where no entry was active, or the URL is null or has no
    host, or the fetch day is null. Rows that repeat a page_id are judged each; other columns are left out.
    """
    rows = captures.select(F.col("page_id"), host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    keys = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = keys.select("host", "fetched", F.explode(suffix).alias("pattern"))
    hit = wanted.join(intervals(entries), "pattern").where("valid_from <= fetched and fetched < valid_to")
    best = hit.groupBy("host", "fetched").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from", "verdict")).alias("x"))
    verdicts = best.select("host", "fetched", "x.pattern", "x.valid_from", "x.verdict")
    return rows.join(verdicts, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", "pattern", "valid_from", F.coalesce("verdict", F.lit("none")).alias("verdict")
    )


#: Rounds of listing that the query derives for each host and domain of the pages.
ROUNDS = 4


def derived_entries(pages: DataFrame) -> DataFrame:
    """A list made from the pages' own hosts and domains: each is added and removed on days that follow from an MD5."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(F.array("host", F.substring_index("host", ".", -2))).alias("pattern")).distinct()
    turns = names.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("r"))
    digits = F.conv(F.substring(F.md5(F.concat("pattern", F.lit("#"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("long")
    turns = turns.withColumn("x", digits).where("x % 3 <> 0")
    begin = (F.col("r") * 90 + F.col("x") % 60).cast("int")
    begins = turns.select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), begin).alias("day"), F.lit("add").alias("action"), F.expr("if(x % 5 = 0, 'allow', 'block')").alias("verdict"))
    ends = turns.select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), (begin + 10 + (F.col("x") % 47).cast("int"))).alias("day"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("verdict"))
    return begins.union(ends)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return judge(pages.withColumn("fetched", fetched), derived_entries(pages))


ORACLE = f"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.$', ''), '') AS host,
    DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched FROM pages),
n AS (SELECT DISTINCT pattern FROM (SELECT host AS pattern FROM p WHERE host IS NOT NULL UNION ALL
      SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM p WHERE host IS NOT NULL)),
t AS (SELECT pattern, r, CAST('0x' || substr(md5(pattern || '#' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) AS x FROM n, range(0, {ROUNDS}) AS g(r)),
e AS (SELECT pattern, DATE '2024-01-01' + CAST(r * 90 + x % 60 AS INT) AS day, 'add' AS action, CASE WHEN x % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict FROM t WHERE x % 3 <> 0
  UNION ALL SELECT pattern, DATE '2024-01-01' + CAST(r * 90 + x % 60 + 10 + x % 47 AS INT), 'remove', NULL FROM t WHERE x % 3 <> 0),
o AS (SELECT pattern, day, max(CAST(action = 'remove' AS INT)) AS gone, min(CASE WHEN action = 'add' THEN verdict END) AS verdict FROM e GROUP BY ALL),
v AS (SELECT pattern, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY pattern ORDER BY day), DATE '{FOREVER}') AS valid_to, gone, verdict FROM o),
j AS (SELECT page_id, host, fetched, pattern, valid_from, verdict FROM p LEFT JOIN (SELECT * FROM v WHERE gone = 0) v
  ON (host = pattern OR ends_with(host, '.' || pattern)) AND valid_from <= fetched AND fetched < valid_to
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC NULLS LAST) = 1)
SELECT page_id, host, fetched, pattern, valid_from, coalesce(verdict, 'none') AS verdict FROM j
"""
