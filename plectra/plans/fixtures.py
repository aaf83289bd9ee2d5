"""Inputs of the registered queries, derived by Spark from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (2500, 5000, 10000, 20000)
LENGTHS = {1: 200_000, 2: 160_000, 3: 120_000}
_LEN = "element_at(array(200000L, 160000L, 120000L), cast({} as int))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chroms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LENGTHS.items()), "idx long, len long")


def pairs(spark: SparkSession, sf_dir: str, control: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    if control:
        rows = rows.where("l_orderkey % 2 = 1")
    rows = rows.selectExpr("*", "1 + l_partkey % 3 AS chr1", "1 + l_suppkey % 3 AS chr2")
    return rows.selectExpr(
        "chr1", "chr2",
        f"(l_partkey * 7919 + l_linenumber * 104729) % {_LEN.format('chr1')} AS pos1",
        f"(l_partkey * 7919 + l_suppkey * 1013) % {_LEN.format('chr2')} AS pos2",
        "l_orderkey % 61 AS mapq1", "l_partkey % 61 AS mapq2",
        "l_returnflag <> 'R' AS strand1", "l_linestatus = 'O' AS strand2",
        "cast(l_quantity AS bigint) AS score",
    )


def loci_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("*", "1 + user_id % 3 AS chr")
    x1 = f"(event_id * 137) % {_LEN.format('chr')}"
    return rows.selectExpr("chr", f"{x1} AS x1", f"{x1} + 50 + (event_id * 31) % 950 AS x2", "event_type AS name", "cast(value AS double) AS score")


def loci_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").selectExpr("*", "1 + o_custkey % 3 AS chr")
    x1 = f"(o_orderkey * 263) % {_LEN.format('chr')}"
    return rows.selectExpr("chr", f"{x1} AS x1", f"{x1} + 200 + (o_custkey * 17) % 1800 AS x2")


def feat_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "1 + p_partkey % 3 AS chr1", "((p_partkey * 37) % 20) * 5000 AS start1", "((p_partkey * 37) % 20) * 5000 + 5000 AS end1",
        "1 + p_partkey % 3 AS chr2",
        "((p_partkey * 37) % 20) * 5000 + (2 + (p_partkey * 13) % 12) * 5000 AS start2",
        "((p_partkey * 37) % 20) * 5000 + (3 + (p_partkey * 13) % 12) * 5000 AS end2",
        "cast(p_retailprice AS double) AS observed", "p_partkey", "cast(p_size AS bigint) AS p_size",
    )


def feat_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = (F.col("p_size") % 5) * 500
    out = feat_a(spark, sf_dir).where("p_partkey % 2 = 0")
    return out.withColumns({c: F.col(c) + shift for c in ("start1", "end1", "start2", "end2")})


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey AS bigint) + 1 AS id", "cast(n_nationkey AS bigint) * 8000 + 1 AS orig_start", "8000L AS length",
        "((cast(n_nationkey AS bigint) * 7) % 25) * 8000 + 1 AS cur_start", "n_regionkey % 2 = 1 AS inverted",
    )


def sites(spark: SparkSession) -> DataFrame:
    return chroms(spark).selectExpr("idx AS chr", "explode(sequence(1L, len div 1000 - 1)) AS k").selectExpr("chr", "k - 1 AS site_idx", "k * 1000 + (k * k * 37) % 700 AS pos")


#: The same inputs as common table expressions; a query goes behind them.
SQL = """
WITH chroms AS (SELECT CAST(idx AS BIGINT) AS idx, CAST(len AS BIGINT) AS len FROM (VALUES (1,200000),(2,160000),(3,120000)) AS t(idx,len)),
raw_pairs AS (SELECT a.idx AS chr1, b.idx AS chr2, (l_partkey*7919 + l_linenumber*104729) % a.len AS pos1, (l_partkey*7919 + l_suppkey*1013) % b.len AS pos2,
  l_orderkey % 61 AS mapq1, l_partkey % 61 AS mapq2, l_returnflag <> 'R' AS strand1, l_linestatus = 'O' AS strand2, CAST(l_quantity AS BIGINT) AS score, l_orderkey AS okey
  FROM lineitem JOIN chroms a ON a.idx = 1 + l_partkey % 3 JOIN chroms b ON b.idx = 1 + l_suppkey % 3),
pairs AS (SELECT * EXCLUDE (okey) FROM raw_pairs),
loci_a AS (SELECT idx AS chr, (event_id*137) % len AS x1, (event_id*137) % len + 50 + (event_id*31) % 950 AS x2, event_type AS name, CAST(value AS DOUBLE) AS score FROM events JOIN chroms ON idx = 1 + user_id % 3),
loci_b AS (SELECT idx AS chr, (o_orderkey*263) % len AS x1, (o_orderkey*263) % len + 200 + (o_custkey*17) % 1800 AS x2 FROM orders JOIN chroms ON idx = 1 + o_custkey % 3 WHERE o_orderkey % 10 = 0),
feat_a AS (SELECT idx AS chr1, ((p_partkey*37) % 20)*5000 AS start1, ((p_partkey*37) % 20)*5000 + 5000 AS end1, idx AS chr2,
  ((p_partkey*37) % 20)*5000 + (2 + (p_partkey*13) % 12)*5000 AS start2, ((p_partkey*37) % 20)*5000 + (3 + (p_partkey*13) % 12)*5000 AS end2,
  CAST(p_retailprice AS DOUBLE) AS observed, p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part JOIN chroms ON idx = 1 + p_partkey % 3),
feat_b AS (SELECT chr1, start1 + s AS start1, end1 + s AS end1, chr2, start2 + s AS start2, end2 + s AS end2, observed, p_partkey, p_size
  FROM (SELECT *, (p_size % 5) * 500 AS s FROM feat_a WHERE p_partkey % 2 = 0)),
scaffolds AS (SELECT CAST(n_nationkey AS BIGINT)+1 AS id, CAST(n_nationkey AS BIGINT)*8000+1 AS orig_start, CAST(8000 AS BIGINT) AS length,
  ((CAST(n_nationkey AS BIGINT)*7) % 25)*8000+1 AS cur_start, n_regionkey % 2 = 1 AS inverted FROM nation),
sites AS (SELECT idx AS chr, k - 1 AS site_idx, k*1000 + (k*k*37) % 700 AS pos FROM (SELECT idx, unnest(range(1, len // 1000)) AS k FROM chroms)),
flip AS (SELECT least(chr1, chr2) AS chr1, greatest(chr1, chr2) AS chr2, CASE WHEN chr1 > chr2 THEN pos2 ELSE pos1 END AS pos1, CASE WHEN chr1 > chr2 THEN pos1 ELSE pos2 END AS pos2,
  CASE WHEN chr1 > chr2 THEN mapq2 ELSE mapq1 END AS mapq1, CASE WHEN chr1 > chr2 THEN mapq1 ELSE mapq2 END AS mapq2,
  CASE WHEN chr1 > chr2 THEN strand2 ELSE strand1 END AS strand1, CASE WHEN chr1 > chr2 THEN strand1 ELSE strand2 END AS strand2, score, okey FROM raw_pairs),
bins AS (SELECT chr1, chr2, bin_size, CASE WHEN chr1 = chr2 THEN least(pos1 // bin_size, pos2 // bin_size) ELSE pos1 // bin_size END AS bin_x,
  CASE WHEN chr1 = chr2 THEN greatest(pos1 // bin_size, pos2 // bin_size) ELSE pos2 // bin_size END AS bin_y, score, okey
  FROM flip, (SELECT CAST(unnest([2500,5000,10000,20000]) AS BIGINT) AS bin_size)),
contacts AS (SELECT chr1, chr2, bin_size, bin_x, bin_y, CAST(sum(score) AS DOUBLE) AS counts FROM bins GROUP BY ALL),
ctrl AS (SELECT chr1, chr2, bin_size, bin_x, bin_y, CAST(sum(score) AS DOUBLE) AS counts FROM bins WHERE okey % 2 = 1 GROUP BY ALL),
both_tri AS (SELECT chr1 AS chr, bin_size, bin_x AS i, bin_y AS j, counts FROM contacts WHERE chr1 = chr2 UNION ALL SELECT chr1, bin_size, bin_y, bin_x, counts FROM contacts WHERE chr1 = chr2 AND bin_x <> bin_y),
rowsums AS (SELECT bin_size, chr, i AS bin, sum(counts) AS value FROM both_tri GROUP BY ALL),
normed AS (SELECT c.*, counts / (v1.value * v2.value) AS nv FROM contacts c JOIN rowsums v1 ON v1.bin_size = c.bin_size AND v1.chr = c.chr1 AND v1.bin = bin_x JOIN rowsums v2 ON v2.bin_size = c.bin_size AND v2.chr = c.chr2 AND v2.bin = bin_y),
vcf AS (SELECT bin_size, chr1 AS chr, sqrt(sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * nv) / sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * counts)) AS factor FROM normed WHERE chr1 = chr2 GROUP BY ALL),
vc AS (SELECT r.bin_size, r.chr, bin, value * factor AS value FROM rowsums r JOIN vcf f ON f.bin_size = r.bin_size AND f.chr = r.chr),
nbins AS (SELECT DISTINCT c.bin_size, c.chr1 AS chr, len // c.bin_size AS n FROM contacts c JOIN chroms ON idx = chr1 WHERE chr1 = chr2),
poss AS (SELECT bin_size, d AS dist, sum(n - d) AS possible FROM nbins, range(0, 200) AS g(d) WHERE d < n GROUP BY ALL),
act AS (SELECT bin_size, bin_y - bin_x AS dist, sum(counts) AS actual FROM contacts WHERE chr1 = chr2 GROUP BY ALL),
actc AS (SELECT bin_size, bin_y - bin_x AS dist, sum(counts) AS actual FROM ctrl WHERE chr1 = chr2 GROUP BY ALL),
ex AS (SELECT p.bin_size, p.dist, coalesce(actual, 0) / possible AS value FROM poss p LEFT JOIN act a ON a.bin_size = p.bin_size AND a.dist = p.dist),
exc AS (SELECT p.bin_size, p.dist, coalesce(actual, 0) / possible AS value FROM poss p LEFT JOIN actc a ON a.bin_size = p.bin_size AND a.dist = p.dist),
avgs AS (SELECT chr1, chr2, bin_size, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) / CAST(any_value(a.len) // bin_size AS DOUBLE) / CAST(any_value(b.len) // bin_size AS DOUBLE) AS av
  FROM contacts JOIN chroms a ON a.idx = chr1 JOIN chroms b ON b.idx = chr2 GROUP BY chr1, chr2, bin_size),
avgsc AS (SELECT chr1, chr2, bin_size, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) / CAST(any_value(a.len) // bin_size AS DOUBLE) / CAST(any_value(b.len) // bin_size AS DOUBLE) AS av
  FROM ctrl JOIN chroms a ON a.idx = chr1 JOIN chroms b ON b.idx = chr2 GROUP BY chr1, chr2, bin_size),
lastd AS (SELECT bin_size, max(dist) AS last FROM poss GROUP BY ALL),
one AS (SELECT c.chr1, c.chr2, c.bin_size, bin_x, bin_y, counts AS o, CASE WHEN c.chr1 = c.chr2 THEN e.value ELSE CASE WHEN av > 0 THEN av ELSE 1 END END AS e,
  CASE WHEN c.chr1 = c.chr2 THEN z.value ELSE CASE WHEN av > 0 THEN av ELSE 1 END END AS e0, av AS a
  FROM contacts c JOIN lastd l ON l.bin_size = c.bin_size LEFT JOIN ex e ON e.bin_size = c.bin_size AND e.dist = least(abs(bin_y - bin_x), last)
  LEFT JOIN ex z ON z.bin_size = c.bin_size AND z.dist = 0 LEFT JOIN avgs v ON v.chr1 = c.chr1 AND v.chr2 = c.chr2 AND v.bin_size = c.bin_size),
onec AS (SELECT c.chr1, c.chr2, c.bin_size, bin_x, bin_y, counts AS c, CASE WHEN c.chr1 = c.chr2 THEN e.value ELSE CASE WHEN av > 0 THEN av ELSE 1 END END AS ec,
  CASE WHEN c.chr1 = c.chr2 THEN z.value ELSE CASE WHEN av > 0 THEN av ELSE 1 END END AS ec0, av AS ac
  FROM ctrl c JOIN lastd l ON l.bin_size = c.bin_size LEFT JOIN exc e ON e.bin_size = c.bin_size AND e.dist = least(abs(bin_y - bin_x), last)
  LEFT JOIN exc z ON z.bin_size = c.bin_size AND z.dist = 0 LEFT JOIN avgsc v ON v.chr1 = c.chr1 AND v.chr2 = c.chr2 AND v.bin_size = c.bin_size),
two AS (SELECT * FROM one JOIN onec USING (chr1, chr2, bin_size, bin_x, bin_y))
"""
