"""Queries on read pairs: projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import binning as B
from plectra.operators import pairs as P
from plectra.operators import stats as S
from plectra.operators import lift as L
from plectra.plans import fixtures as fx
from plectra.plans.book import Book
from plectra.plans.storage import scratch_dir

BOOK = Book()
COLS = "chr1, chr2, pos1, pos2, mapq1, mapq2, strand1, strand2, score"


def _q(name, f, sql):
    BOOK.add(name, lambda spark, d: f(spark, fx.pairs(spark, d)), sql)


_q("flt_contig", lambda s, p: P.known_contigs(p, fx.chroms(s).where("idx <> 3")), f"SELECT {COLS} FROM pairs WHERE chr1 IN (1,2) AND chr2 IN (1,2)")
_q("flt_diagonal", lambda s, p: P.intra_only(p), f"SELECT {COLS} FROM pairs WHERE chr1 = chr2")
_q("flt_chroms", lambda s, p: P.in_chromosomes(p, [1, 3]), f"SELECT {COLS} FROM pairs WHERE chr1 IN (1,3) AND chr2 IN (1,3)")
_q("flt_alignment", lambda s, p: P.with_alignment(p, "inner"), f"SELECT {COLS} FROM pairs WHERE strand1 <> strand2 AND CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END")
_q("flt_alignment_outer", lambda s, p: P.with_alignment(p, "outer"), f"SELECT {COLS} FROM pairs WHERE strand1 <> strand2 AND NOT CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END")
_q("flt_alignment_tandem", lambda s, p: P.with_alignment(p, "tandem"), f"SELECT {COLS} FROM pairs WHERE strand1 = strand2")
_q("flt_mapq", lambda s, p: P.min_mapq(p, 30), f"SELECT {COLS} FROM pairs WHERE least(coalesce(mapq1,1000), coalesce(mapq2,1000)) >= 30")
_q("prj_flip", lambda s, p: P.flipped(p), f"SELECT {COLS} FROM flip")
_q(
    "prj_clamp",
    lambda s, p: P.clamped(p.withColumn("pos1", F.col("pos1") * 2 - 1000), fx.chroms(s)).select(*COLS.split(", ")),
    "SELECT chr1, chr2, least(greatest(pos1 * 2 - 1000, 0), a.len) AS pos1, pos2, mapq1, mapq2, strand1, strand2, score FROM pairs JOIN chroms a ON a.idx = chr1",
)
_q(
    "prj_whole_genome_pos",
    lambda s, p: P.whole_genome(p, fx.chroms(s)).select("chr1", "chr2", "pos1", "pos2", "score"),
    """SELECT CAST(0 AS BIGINT) AS chr1, CAST(0 AS BIGINT) AS chr2, (pos1 + CASE chr1 WHEN 1 THEN 0 WHEN 2 THEN 200000 ELSE 360000 END) // 1000 AS pos1,
    (pos2 + CASE chr2 WHEN 1 THEN 0 WHEN 2 THEN 200000 ELSE 360000 END) // 1000 AS pos2, score FROM pairs""",
)
_q("prj_bin", lambda s, p: B.binned(p, 2500).select("chr1", "chr2", "bin_size", "bin_x", "bin_y", "score"), "SELECT chr1, chr2, bin_size, bin_x, bin_y, score FROM bins WHERE bin_size = 2500")
_q(
    "prj_block_number",
    lambda s, p: B.binned(p, 2500).select("chr1", "chr2", "bin_x", "bin_y", B.block_number(8, 10).alias("block_number")).distinct(),
    """SELECT DISTINCT chr1, chr2, bin_x, bin_y, CASE WHEN chr1 = chr2 THEN CAST(floor(log2(1 + abs(bin_x - bin_y) / sqrt(2.0) / 8)) AS BIGINT) * 10 + ((bin_x + bin_y) // 2) // 8
    ELSE (bin_y // 8) * 10 + bin_x // 8 END AS block_number FROM bins WHERE bin_size = 2500""",
)
_FRAGS = """, fr AS (SELECT p.*, (SELECT count(*) FROM sites s WHERE s.chr = p.chr1 AND s.pos <= p.pos1) AS frag1, (SELECT count(*) FROM sites s WHERE s.chr = p.chr2 AND s.pos <= p.pos2) AS frag2 FROM
  (SELECT * FROM pairs) p)"""


def _with_frags(s, p):
    return L.fragments(L.fragments(p, fx.sites(s), "chr1", "pos1", "frag1"), fx.sites(s), "chr2", "pos2", "frag2")


_q("join_frag", lambda s, p: _with_frags(s, p).select("chr1", "pos1", "frag1", "chr2", "pos2", "frag2"), _FRAGS + " SELECT chr1, pos1, frag1, chr2, pos2, frag2 FROM fr")
_q("flt_intra_frag", lambda s, p: P.across_fragments(_with_frags(s, p)).select("chr1", "pos1", "frag1", "chr2", "pos2", "frag2"), _FRAGS + " SELECT chr1, pos1, frag1, chr2, pos2, frag2 FROM fr WHERE NOT (chr1 = chr2 AND frag1 = frag2)")
_q(
    "join_site_distance",
    lambda s, p: L.site_distance(p, fx.sites(s), "chr1", "pos1").select("chr1", "pos1", "site_distance"),
    "SELECT chr1, pos1, (SELECT min(abs(s.pos - p.pos1)) FROM sites s WHERE s.chr = p.chr1) AS site_distance FROM pairs p",
)
_q("flt_subsample", lambda s, p: P.subsample(p, 0.25, ["chr1", "pos1", "chr2", "pos2", "mapq1"]), None)
_q("prj_randomize", lambda s, p: P.randomized(_with_frags(s, p), fx.sites(s)).select("chr1", "pos1", "chr2", "pos2", "score"), None)
_q("stat_pairs", lambda s, p: S.pair_statistics(_with_frags(s, p), (1, 30)), _FRAGS + """, st AS (SELECT t.threshold, fr.*, least(mapq1, mapq2) >= t.threshold AS good, chr1 = chr2 AND frag1 = frag2 AS same_frag,
  abs(pos1 - pos2) AS d FROM fr, (SELECT CAST(unnest([1, 30]) AS INT) AS threshold) t)
SELECT threshold, n_unique, COLUMNS('n_[^u].*|n_under_500')::BIGINT FROM (SELECT threshold, count(*) AS n_unique, count_if(same_frag) AS n_intra_fragment, count_if(NOT same_frag AND NOT good) AS n_below_mapq, count_if(NOT same_frag AND good) AS n_contacts,
 count_if(NOT same_frag AND good AND chr1 <> chr2) AS n_inter, count_if(NOT same_frag AND good AND chr1 = chr2) AS n_intra,
 count_if(NOT same_frag AND good AND chr1 = chr2 AND d < 500) AS n_under_500, count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 500 AND d < 5000) AS n_500_5k,
 count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 5000 AND d < 20000) AS n_5k_20k, count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 20000) AS n_over_20k,
 count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 20000 AND NOT strand1 AND NOT strand2) AS n_left, count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 20000 AND strand1 <> strand2 AND CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END) AS n_inner,
 count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 20000 AND strand1 <> strand2 AND NOT CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END) AS n_outer, count_if(NOT same_frag AND good AND chr1 = chr2 AND d >= 20000 AND strand1 AND strand2) AS n_right
FROM st GROUP BY threshold)""")
_q("stat_hist_distance", lambda s, p: S.distance_histogram(p), """, h AS (SELECT CASE WHEN strand1 = strand2 THEN CASE WHEN strand1 THEN 'right' ELSE 'left' END WHEN CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END THEN 'inner' ELSE 'outer' END AS orientation,
  abs(pos1 - pos2) AS d FROM pairs WHERE chr1 = chr2)
SELECT orientation, CAST(CASE WHEN d < 1 THEN 0 ELSE least(99, floor(log10(d) * 12.5 + 1e-9)) END AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY ALL""")
_q("stat_hist_mapq", lambda s, p: S.mapq_histogram(p), "SELECT least(mapq1, mapq2) AS mapq, count(*) AS n FROM pairs WHERE least(mapq1, mapq2) <= 200 GROUP BY ALL")
_q("stat_hist_site", lambda s, p: S.site_histogram(p, fx.sites(s)), ", d AS (SELECT (SELECT min(abs(s.pos - p.pos1)) FROM sites s WHERE s.chr = p.chr1) AS site_distance FROM pairs p) SELECT site_distance, count(*) AS n FROM d WHERE site_distance <= 2000 GROUP BY ALL")
_q("stat_lior_convergence", lambda s, p: S.lior_convergence(p), None)
_q("stat_library_size", lambda s, p: S.library_size_of(p, ["chr1", "pos1", "chr2", "pos2", "strand1", "strand2"]), None)
_q("stat_duplicates", lambda s, p: S.duplicate_counts(p, ["chr1", "pos1", "chr2", "pos2", "strand1", "strand2"]), """, g AS (SELECT chr1, pos1, chr2, pos2, strand1, strand2, count(*) AS c FROM pairs GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_total, count(*) AS n_unique, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM g""")


def _merged_statistics(s, p):
    """Statistics of two halves of the pairs, written as text files, read back and merged."""
    path = scratch_dir(s)
    for half in (0, 1):
        S.statistics_lines(S.pair_statistics(_with_frags(s, p.where(f"mapq1 % 2 = {half}")), (30,))).select("value").write.text(f"{path}/{half}")
    return S.merge_statistics(s.read.text([f"{path}/0", f"{path}/1"]))


_q("stat_merge", _merged_statistics, _FRAGS + """, st AS (SELECT *, least(mapq1, mapq2) >= 30 AS good, chr1 = chr2 AND frag1 = frag2 AS same_frag, abs(pos1 - pos2) AS d, CASE WHEN strand1 = strand2 THEN CASE WHEN strand1 THEN 'r' ELSE 'l' END WHEN CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END THEN 'i' ELSE 'o' END AS o FROM fr),
ct AS (SELECT *, NOT same_frag AND good AS hit, NOT same_frag AND good AND chr1 = chr2 AS own FROM st),
ev AS (SELECT CASE WHEN bool_and(round(n * 100.0 / greatest(t, 1)) = 25) THEN 25 ELSE -1 END AS e FROM (SELECT h, q.o, count_if(own AND d >= 20000 AND ct.o = q.o) AS n, count_if(own AND d >= 20000) AS t FROM (SELECT *, mapq1 % 2 AS h FROM ct) ct, (SELECT unnest(['l', 'i', 'o', 'r']) AS o) q GROUP BY h, q.o))
SELECT statistic, CAST(value AS BIGINT) AS value FROM (SELECT unnest(['n_unique', 'n_intra_fragment', 'n_below_mapq', 'n_contacts', 'n_inter', 'n_intra', 'n_under_500', 'n_500_5k', 'n_5k_20k', 'n_over_20k']) AS statistic,
 unnest([count(*), count_if(same_frag), count_if(NOT same_frag AND NOT good), count_if(hit), count_if(hit AND chr1 <> chr2), count_if(own), count_if(own AND d < 500), count_if(own AND d >= 500 AND d < 5000), count_if(own AND d >= 5000 AND d < 20000), count_if(own AND d >= 20000)]) AS value FROM ct
UNION ALL SELECT 'pair_percents', e FROM ev)""")
_q("filter_pairs_build", lambda s, p: P.filter_pairs(p, mapq=10, chroms=[1, 2], diagonal=True, alignment="tandem"), f"SELECT {COLS} FROM pairs WHERE chr1 = chr2 AND chr1 IN (1,2) AND strand1 = strand2 AND least(mapq1, mapq2) >= 10")
