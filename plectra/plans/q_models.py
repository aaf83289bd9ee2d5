"""Queries of iterative balancing, correlation, loops, domains and localisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import balancing as W
from plectra.operators import binning as B
from plectra.operators import correlation as C
from plectra.operators import domains as O
from plectra.operators import expected as E
from plectra.operators import localizer as L
from plectra.operators import models as M
from plectra.operators import norm as N
from plectra.operators import views as V
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded
from plectra.plans.q_maps import contacts, held
from plectra.plans.storage import stored

BOOK = Book()


def _q(name, f, sql=None, sizes=(10000,)):
    BOOK.add(name, lambda s, d: f(s, contacts(s, d, sizes=sizes)), sql)


def _oe(s, c):
    return V.view(V.one_map(c, fx.chroms(s)), V.one_map_views()["q_oe"])


_q("norm_scale", lambda s, c: rounded(W.scale(c), "value", digits=3))
_q("norm_kr", lambda s, c: rounded(W.knight_ruiz(c), "value", digits=4))
for _name in ("KR", "SCALE"):
    _q(f"norm_gw_{_name.lower()}" if _name == "KR" else "norm_gw", lambda s, c, n=_name: rounded(W.balanced(c, fx.chroms(s), f"GW_{n}"), "value", digits=3))
    _q(f"norm_inter_{_name.lower()}" if _name == "KR" else "norm_inter", lambda s, c, n=_name: rounded(W.balanced(c, fx.chroms(s), f"INTER_{n}"), "value", digits=3))
_WHOLE = """, gb AS (SELECT idx, coalesce(sum(len // 10000 + 1) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM chroms),
gc AS (SELECT bin_x + a.o AS x, bin_y + b.o AS y, counts FROM contacts c JOIN gb a ON a.idx = chr1 JOIN gb b ON b.idx = chr2 WHERE c.bin_size = 10000 AND {}),
gr AS (SELECT i, sum(counts) AS v FROM (SELECT x AS i, counts FROM gc UNION ALL SELECT y, counts FROM gc WHERE x <> y) GROUP BY i),
gf AS (SELECT sqrt(sum(CASE WHEN x <> y THEN 2 ELSE 1 END * counts / (a.v * b.v)) / sum(CASE WHEN x <> y THEN 2 ELSE 1 END * counts)) AS f FROM gc JOIN gr a ON a.i = x JOIN gr b ON b.i = y)
SELECT CAST(10000 AS BIGINT) AS bin_size, gb.idx AS chr, i - o AS bin, round(v * f, 6) AS value FROM gr CROSS JOIN gf JOIN gb ON true JOIN chroms ON chroms.idx = gb.idx WHERE i >= o AND i < o + len // 10000 + 1"""
_q("norm_gw_vc", lambda s, c: rounded(W.balanced(c, fx.chroms(s), "GW_VC"), "value"), _WHOLE.format("true"))
_q("norm_inter_vc", lambda s, c: rounded(W.balanced(c, fx.chroms(s), "INTER_VC"), "value"), _WHOLE.format("chr1 <> chr2"))
_q("mat_pearson", lambda s, c: rounded(C.pearson(_oe(s, c), fx.chroms(s)), "value"), """, oe AS (SELECT chr1 AS chr, bin_x AS i, bin_y AS j, o / e AS v FROM one WHERE chr1 = chr2 AND bin_size = 10000 AND e <> 0),
sy AS (SELECT chr, i, j, v FROM oe UNION ALL SELECT chr, j, i, v FROM oe WHERE i <> j), nb AS (SELECT idx AS chr, (len - 1) // 10000 + 1 AS n FROM chroms), oc AS (SELECT DISTINCT chr, i FROM sy WHERE v <> 0),
gr AS (SELECT nb.chr, oc.i, g.j FROM nb JOIN oc ON oc.chr = nb.chr, range(0, 20) AS g(j) WHERE g.j < n), mt AS (SELECT gr.chr, gr.i, gr.j, coalesce(v, 0) AS v FROM gr LEFT JOIN sy ON sy.chr = gr.chr AND sy.i = gr.i AND sy.j = gr.j),
mu AS (SELECT gr.chr, gr.j, coalesce(sum(v), 0) / any_value(n) AS m FROM gr JOIN nb ON nb.chr = gr.chr LEFT JOIN sy ON sy.chr = gr.chr AND sy.i = gr.j AND sy.j = gr.i GROUP BY gr.chr, gr.j),
mr AS (SELECT chr, i, sum(v) AS rs FROM sy GROUP BY ALL), mm AS (SELECT g.chr, g.j, coalesce(rs, 0) / n AS m FROM (SELECT DISTINCT chr, j FROM gr) g JOIN nb ON nb.chr = g.chr LEFT JOIN mr ON mr.chr = g.chr AND mr.i = g.j),
ce AS (SELECT mt.chr, mt.i, mt.j, v - m AS v FROM mt JOIN mm ON mm.chr = mt.chr AND mm.j = mt.j)
SELECT CAST(10000 AS BIGINT) AS bin_size, a.chr, a.i, b.i AS j, round(CASE WHEN a.i = b.i THEN 1.0 ELSE corr(a.v, b.v) END, 6) AS value FROM ce a JOIN ce b ON a.chr = b.chr AND a.j = b.j AND a.i <= b.i GROUP BY a.chr, a.i, b.i""")
_q("mat_eigen", lambda s, c: rounded(C.eigenvector(_oe(s, c), fx.chroms(s)), "value", digits=4))
BOOK.add("ab_diff", lambda s, d: rounded(M.compartment_difference(C.eigenvector(_oe(s, contacts(s, d, sizes=(10000,))), fx.chroms(s)), C.eigenvector(_oe(s, contacts(s, d, True, sizes=(10000,))), fx.chroms(s))), "same", "different", digits=4))
_PEARSON_BOTH = BOOK.oracles["mat_pearson"].removeprefix(f"{fx.SQL}\n").replace("\nSELECT CAST(10000", ", pe AS (SELECT CAST(10000") + ") SELECT chr, i, j, value FROM pe UNION ALL SELECT chr, j, i, value FROM pe WHERE i < j"
_q("q_pearson", lambda s, c: rounded(B.mirrored(C.pearson(_oe(s, c), fx.chroms(s)).selectExpr("chr AS chr1", "chr AS chr2", "bin_size", "i AS bin_x", "j AS bin_y", "value AS counts")).select(F.col("chr1").alias("chr"), "i", "j", F.col("counts").alias("value")), "value"), _PEARSON_BOTH)
_q("dom_directionality", lambda s, c: rounded(M.directionality(c, 7), "value"), """, u AS (SELECT bin_size, chr1 AS chr, bin_y AS i, bin_y - bin_x AS d, counts AS a FROM contacts WHERE chr1 = chr2 AND bin_size = 2500 AND bin_y - bin_x >= 7),
w AS (SELECT bin_size, chr1 AS chr, bin_x AS i, bin_y - bin_x AS d, counts AS b FROM contacts WHERE chr1 = chr2 AND bin_size = 2500 AND bin_y - bin_x >= 7)
SELECT chr, bin_size, i, d, round((coalesce(a, 0) - coalesce(b, 0)) / (coalesce(a, 0) + coalesce(b, 0)), 6) AS value FROM u FULL JOIN w USING (bin_size, chr, i, d)""", (2500,))
#: Length of the domains that the pairs are folded into.
_DOMAIN = 40_000


def _domain_cells(s, d, size=2000):
    """A map with domains: the second end of a pair goes to some place of its first end's domain."""
    folded = fx.pairs(s, d).withColumns({"chr2": F.col("chr1"), "pos2": F.expr(f"pos1 - pos1 % {_DOMAIN} + pmod(xxhash64(pos1, pos2, score), {_DOMAIN})")})
    return B.bin_contacts(folded, [size])


def _boxes(s, d):
    return fx.feat_a(s, d).where("chr1 = chr2").select(F.col("chr1").alias("chr"), "start1", "end1", "start2", "end2")


BOOK.add("dom_sliding", lambda s, d: rounded(O.domains(_domain_cells(s, d), fx.chroms(s), width=50, gap=3, smallest=10), *O.VALUES, digits=4))
BOOK.add("dom_threshold", lambda s, d: rounded(O.found_blocks(_domain_cells(s, d), fx.chroms(s), width=50, gap=3), *O.VALUES, digits=4))
BOOK.add("dom_score_list", lambda s, d: rounded(O.domain_scores(contacts(s, d, sizes=(5000,)), fx.chroms(s), _boxes(s, d), 40, 3), "score", digits=4))


def _kernel(s, c):
    expected = E.raw_expected(c, fx.chroms(s)).select("dist", "value")
    return M.loop_kernel(c, expected, None, window=5, peak=1, tile=40)


_q("loop_tiles", lambda s, c: M.tiles(c, 40).groupBy("chr1", "ti", "tj").agg(F.count("*").alias("cells")), """, tl AS (SELECT chr, i, j, a.t AS ti, b.t AS tj FROM (SELECT * FROM both_tri WHERE bin_size = 2500), range(0, 4) a(t), range(0, 4) b(t) WHERE a.t <= b.t AND i BETWEEN a.t * 40 - 20 AND a.t * 40 + 59 AND j BETWEEN b.t * 40 - 20 AND b.t * 40 + 59)
SELECT chr AS chr1, ti, tj, count(*) AS cells FROM tl GROUP BY ALL""", (2500,))
_q("loop_kernel", lambda s, c: rounded(_kernel(s, c), "bl", "donut", "h", "v"), None, (2500,))
_q("loop_hist", lambda s, c: M.loop_histogram(_kernel(s, c)), None, (2500,))
_q("loop_fdr", lambda s, c: rounded(M.loop_fdr(M.loop_histogram(_kernel(s, c))), "fdr"), None, (2500,))


def _enriched(s, c):
    k = _kernel(s, c)
    return M.loop_enriched(k, M.loop_fdr(M.loop_histogram(k), 1.0))


_q("loop_enriched", lambda s, c: rounded(_enriched(s, c).select("chr", "i", "j", "observed", "donut"), "donut"), None, (2500,))
_q("loop_filter", lambda s, c: rounded(M.loop_calls(stored(_enriched(s, c)), 2500, 5000, sides=1.1, corner=1.2, donut_corner=1.3, fdr_sum=0.5).select("chr", "i", "j", "x", "y", "pixels", "observed", "donut"), "donut"), None, (2500,))
_q("loop_coalesce", lambda s, c: M.loop_coalesce(M.loop_filter(_kernel(s, c), 1.1, 1.2, 1.3), 2500, 5000), None, (2500,))
def _covered(s, c):
    """Every 23rd bin of the map is left empty, so it has no value of a vector."""
    cells = stored(c.where("bin_x % 23 <> 0 and bin_y % 23 <> 0"))
    bad = M.bins_without_value(N.vanilla_coverage(cells), fx.chroms(s), 2500)
    return M.loop_low_coverage(M.loop_filter(_kernel(s, cells), 1.1, 1.2, 1.3), bad).select("chr", "i", "j", "observed")


_q("loop_lowmapq", _covered, None, (2500,))
_q("loop_thresholds", lambda s, c: rounded(M.loop_thresholds(stored(M.loop_significance(_kernel(s, c))), 0.5), "threshold", digits=9), None, (2500,))


def _significant(s, c):
    tested = stored(M.loop_significance(_kernel(s, c)))
    return rounded(M.loop_significant(tested, M.loop_thresholds(tested, 0.5)), "p_bl", "p_donut", "p_h", "p_v")


_q("loop_significant", _significant, None, (2500,))
BOOK.add("loop_configs", lambda s, d: contacts(s, d).groupBy("bin_size").agg(F.count("*").alias("cells")).join(F.broadcast(M.loop_settings(s)), "bin_size"), """SELECT bin_size, count(*) AS cells, fdr, peak, "window", radius
FROM contacts JOIN (VALUES (5000, 10, 4, 7, 20000), (10000, 10, 2, 5, 20000), (25000, 10, 1, 3, 50000)) t(z, fdr, peak, "window", radius) ON z = bin_size GROUP BY bin_size, fdr, peak, "window", radius""")
_q("loop_pvalue", lambda s, c: rounded(M.loop_pvalues(_kernel(s, c)), "p_bl", "p_donut", "p_h", "p_v"), None, (2500,))


def _localized(s, d, **settings):
    cells = held(s, d, sizes=(2500,))
    vectors = N.vanilla_coverage(cells).select("chr", "bin", "value")
    return rounded(L.localize(cells, fx.feat_a(s, d), 2500, vectors, **settings), "p", digits=9)


BOOK.add("loc_run", lambda s, d: _localized(s, d, peaks=2))
BOOK.add("top_peaks", lambda s, d: _localized(s, d, max_p=1.0))
_q("flt_subsample_counts", lambda s, c: M.thinned(c, 0.5), None, (5000,))
