"""Queries on intervals, tracks and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import binning as B
from plectra.operators import intervals as I
from plectra.operators import lift as L
from plectra.operators import tracks as T
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded

BOOK = Book()


def _q(name, f, sql):
    BOOK.add(name, lambda s, d: f(s, fx.loci_a(s, d), fx.loci_b(s, d)), sql)


_HIT = ", hit AS (SELECT a.chr, a.x1, a.x2, score, b.x1 AS b1, b.x2 AS b2 FROM loci_a a JOIN (SELECT DISTINCT * FROM loci_b) b ON a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2), cnt AS (SELECT *, count(*) OVER (PARTITION BY chr, b1, b2) AS n FROM hit)"
_MERGED = """, ord AS (SELECT chr, x1, x2, max(x2) OVER (PARTITION BY chr ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM (SELECT DISTINCT chr, x1, x2 FROM {})),
isl AS (SELECT *, sum(CASE WHEN pm IS NULL OR x1 > pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS k FROM ord), mg AS (SELECT chr, min(x1) AS x1, max(x2) AS x2 FROM isl GROUP BY chr, k)"""
_q("iv_intersect", lambda s, a, b: I.intersect(a, b), "SELECT DISTINCT a.chr, greatest(a.x1, b.x1) AS x1, least(a.x2, b.x2) AS x2 FROM loci_a a JOIN loci_b b ON a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2")
_q("iv_preserve_intersect", lambda s, a, b: I.keep_intersecting(a, b), "SELECT DISTINCT a.chr, a.x1, a.x2 FROM loci_a a WHERE EXISTS (SELECT 1 FROM loci_b b WHERE a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2)")
_q("iv_retain_unique", lambda s, a, b: I.retain_unique(b.selectExpr("chr", "x1", "x1 + 60 AS x2"), a.selectExpr("chr", "x1", "x1 + 5 AS x2", "score")), """, h AS (SELECT a.chr, a.x1, a.x1 + 5 AS x2, score, count(*) OVER (PARTITION BY a.chr, b1) AS n
 FROM (SELECT DISTINCT chr, x1, x1 + 5 AS x2, score FROM loci_a) a JOIN (SELECT DISTINCT chr, x1 AS b1, x1 + 60 AS b2 FROM loci_b) b ON a.chr = b.chr AND a.x1 <= b2 AND b1 <= a.x2) SELECT DISTINCT chr, x1, x2, score FROM h WHERE n = 1""")
_q("iv_retain_multi", lambda s, a, b: I.retain_multi(b, a), _HIT + " SELECT DISTINCT chr, x1, x2, score FROM cnt WHERE n > 1")
_q("iv_retain_best", lambda s, a, b: I.retain_best(b, a), _HIT + " SELECT DISTINCT chr, x1, x2, score FROM (SELECT *, row_number() OVER (PARTITION BY chr, b1, b2 ORDER BY score DESC, x1, x2) AS r FROM hit) WHERE r = 1")
_q("iv_merge", lambda s, a, b: I.merge(b), _MERGED.format("loci_b") + " SELECT chr, x1, x2 FROM mg")
_q("iv_merge_smaller", lambda s, a, b: I.merge_keep_smaller(b), None)
_q("iv_expand_small", lambda s, a, b: I.expand_small(b, 1500), ", wide AS (SELECT chr, x1 - greatest(0, 1500 - (x2 - x1)) // 2 AS x1, x2 + greatest(0, 1500 - (x2 - x1)) // 2 AS x2 FROM loci_b)" + _MERGED.format("wide") + " SELECT chr, x1, x2 FROM mg")
_q("agg_unique_bin", lambda s, a, b: I.unique_in_bin(a.select("chr", "x1", "x2", "score"), 200), "SELECT chr, x1, x2, score FROM (SELECT *, count(*) OVER (PARTITION BY chr, x1 // 200, x2 // 200) AS n FROM loci_a) WHERE n = 1")
_q("agg_best_bin", lambda s, a, b: I.best_in_bin(a, 500), "SELECT chr, x1, x2, score FROM (SELECT *, row_number() OVER (PARTITION BY chr, x1 // 500, x2 // 500 ORDER BY score DESC, x1, x2) AS r FROM loci_a) WHERE r = 1")
_q("agg_distinct", lambda s, a, b: a.select("chr", "x1", "x2").dropDuplicates(), "SELECT DISTINCT chr, x1, x2 FROM loci_a")
_q("srt_loci", lambda s, a, b: b.orderBy("chr", "x1", "x2"), "SELECT chr, x1, x2 FROM loci_b ORDER BY 1, 2, 3")
_q("genes", lambda s, a, b: I.keep_intersecting(a.where("name = 'click'"), b), "SELECT DISTINCT a.chr, a.x1, a.x2 FROM loci_a a WHERE name = 'click' AND EXISTS (SELECT 1 FROM loci_b b WHERE a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2)")
_TRACK = "SELECT chr, x1 AS start, x2 AS \"end\", score AS value FROM loci_a"


def _track(a):
    return a.select("chr", F.col("x1").alias("start"), F.col("x2").alias("end"), F.col("score").alias("value"))


_q("trk_bin_mean_max", lambda s, a, b: rounded(T.bin_mean_max(_track(a), 2500), "mean", "max"), "SELECT chr, bin, round(avg(score), 6) AS mean, round(max(score), 6) AS max FROM (SELECT chr, unnest(range(x1 // 2500, x2 // 2500 + 1)) AS bin, score FROM loci_a) GROUP BY ALL")
_q("trk_tumbling_bin", lambda s, a, b: rounded(T.tumbling(_track(a), fx.chroms(s), 1000), "mean", "max"), """, ab AS (SELECT idx AS chr, unnest(range(0, (len - 1) // 1000 + 1)) AS bin FROM chroms), m AS (SELECT chr, ((x1 + x2) // 2) // 1000 AS bin, avg(score) AS mean, max(score) AS max FROM loci_a GROUP BY ALL)
SELECT ab.chr, ab.bin, round(coalesce(mean, 0), 6) AS mean, round(coalesce(max, 0), 6) AS max FROM ab LEFT JOIN m USING (chr, bin)""")
_q("frag_lookup", lambda s, a, b: L.annotate_fragments(b, fx.sites(s)), "SELECT chr, x1, x2, (SELECT count(*) FROM sites s WHERE s.chr = b.chr AND s.pos <= b.x1) AS first_frag, (SELECT count(*) FROM sites s WHERE s.chr = b.chr AND s.pos <= b.x2) AS last_frag FROM loci_b b")
_q("frag_to_bed", lambda s, a, b: L.fragments_to_bed(fx.sites(s), fx.chroms(s)).join(L.annotate_fragments(b, fx.sites(s)).select("chr", F.col("first_frag").alias("frag")).distinct(), ["chr", "frag"], "left_semi"), """, fb AS (SELECT chr, coalesce(lag(pos) OVER (PARTITION BY chr ORDER BY site_idx), 0) AS start, pos AS "end", site_idx AS frag FROM sites
 UNION ALL SELECT chr, max(pos), any_value(len), max(site_idx) + 1 FROM sites JOIN chroms ON idx = chr GROUP BY chr)
SELECT chr, frag, start, "end" FROM fb WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT b.chr AS c, (SELECT count(*) FROM sites s WHERE s.chr = b.chr AND s.pos <= b.x1) AS f FROM loci_b b) q WHERE c = fb.chr AND f = fb.frag)""")
_CUSTOM = _MERGED.format("loci_b") + ", cu AS (SELECT chr, x1, x2, coalesce(sum(x2 - x1 + 10) OVER (ORDER BY chr, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM mg)"
_q("custom_chrom", lambda s, a, b: L.custom_chromosome(I.merge(b), 10), _CUSTOM + " SELECT chr, x1, x2, new_start FROM cu")
_q("track_lift", lambda s, a, b: rounded(L.lift_track(_track(a), L.custom_chromosome(I.merge(b), 10)), "value"), _CUSTOM + ' SELECT greatest(a.x1, cu.x1) + new_start - cu.x1 AS start, least(a.x2, cu.x2) + new_start - cu.x1 AS "end", round(score, 6) AS value FROM loci_a a JOIN cu ON a.chr = cu.chr AND a.x1 <= cu.x2 AND cu.x1 <= a.x2')
_q("iv_custom_region", lambda s, a, b: I.covering(a.select("chr", "x1", "x2"), I.merge(b), F.expr("(x1 + x2) div 2")).select("chr", "x1", "x2", "r1", "r2"), _MERGED.format("loci_b") + " SELECT a.chr, a.x1, a.x2, mg.x1 AS r1, mg.x2 AS r2 FROM loci_a a JOIN mg ON a.chr = mg.chr AND (a.x1 + a.x2) // 2 BETWEEN mg.x1 AND mg.x2")


def _cells1(s, d):
    return B.bin_contacts(fx.pairs(s, d), [2000]).where("chr1 = 1 and chr2 = 1")


BOOK.add("asm_lift", lambda s, d: L.lift_contacts(_cells1(s, d), fx.scaffolds(s, d), 2000), """, c2 AS (SELECT least(pos1 // 2000, pos2 // 2000) AS x, greatest(pos1 // 2000, pos2 // 2000) AS y, CAST(sum(score) AS DOUBLE) AS counts FROM flip WHERE chr1 = 1 AND chr2 = 1 GROUP BY ALL),
mv AS (SELECT b AS bin, CASE WHEN inverted THEN (cur_start + length - 1 - p + 2 - 2000 + orig_start - 1 - 1) // 2000 ELSE (cur_start + p - orig_start - 1) // 2000 END AS nb FROM (SELECT unnest(range(0, 100)) AS b, b * 2000 + 1 AS p) JOIN scaffolds ON p >= orig_start AND p < orig_start + length)
SELECT CAST(1 AS BIGINT) AS chr1, CAST(1 AS BIGINT) AS chr2, CAST(2000 AS BIGINT) AS bin_size, least(coalesce(a.nb, x), coalesce(b.nb, y)) AS bin_x, greatest(coalesce(a.nb, x), coalesce(b.nb, y)) AS bin_y, sum(counts) AS counts FROM c2 LEFT JOIN mv a ON a.bin = x LEFT JOIN mv b ON b.bin = y GROUP BY ALL""")
BOOK.add("iv_scaffold_lift", lambda s, d: L._lift_axis(_cells1(s, d), fx.scaffolds(s, d), 2000, "bin_x").select("bin_x", F.col("bin_x__").alias("new_x")).distinct(), """, mv AS (SELECT b AS bin, CASE WHEN inverted THEN (cur_start + length - 1 - p + 2 - 2000 + orig_start - 1 - 1) // 2000 ELSE (cur_start + p - orig_start - 1) // 2000 END AS nb FROM (SELECT unnest(range(0, 100)) AS b, b * 2000 + 1 AS p) JOIN scaffolds ON p >= orig_start AND p < orig_start + length)
SELECT DISTINCT least(pos1 // 2000, pos2 // 2000) AS bin_x, nb AS new_x FROM flip JOIN mv ON bin = least(pos1 // 2000, pos2 // 2000) WHERE chr1 = 1 AND chr2 = 1""")
BOOK.add(
    "asm_place",
    lambda s, d: L.place_scaffolds(fx.table(s, d, "supplier").selectExpr("cast(s_suppkey as bigint) AS ord", "cast(if(s_suppkey % 3 = 0, -1, 1) * (s_suppkey + 1) as bigint) AS signed_id", "cast(1000 + s_nationkey * 10 as bigint) AS length", "s_suppkey % 2 = 0 AS was_inverted")),
    "SELECT CAST(s_suppkey AS BIGINT) AS ord, CAST(s_suppkey AS BIGINT) + 1 AS id, CAST(1000 + s_nationkey * 10 AS BIGINT) AS length, coalesce(sum(1000 + s_nationkey * 10) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS cur_start, (s_suppkey % 3 = 0) <> (s_suppkey % 2 = 0) AS inverted FROM supplier",
)
