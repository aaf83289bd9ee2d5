"""Queries on contact maps: binning, distance models, coverage, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div
from plectra.operators import binning as B
from plectra.operators import expected as E
from plectra.operators import norm as N
from plectra.operators import tracks as T
from plectra.operators import views as V
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded
from plectra.plans.storage import scratch_dir, stored
from plectra.sources import store as ST

BOOK = Book()
KEYS = "chr1, chr2, bin_size, bin_x, bin_y"


def contacts(spark, d, control=False, sizes=fx.SIZES):
    return B.bin_contacts(fx.pairs(spark, d, control), list(sizes))


def held(spark, d, control=False, sizes=fx.SIZES):
    """Cells written once, as a map in the store is: several parts of a view read them."""
    return stored(contacts(spark, d, control, sizes))


def shelved(spark, d, control=False, sizes=fx.SIZES):
    """The path of a store with the map's cells."""
    path = scratch_dir(spark)
    ST.write_store(contacts(spark, d, control, sizes), path)
    return path


def _q(name, f, sql, sizes=fx.SIZES):
    BOOK.add(name, lambda s, d: f(s, contacts(s, d, sizes=sizes)), sql)


def _qh(name, f, sql, sizes=fx.SIZES):
    """A query that reads the cells several times."""
    BOOK.add(name, lambda s, d: f(s, held(s, d, sizes=sizes)), sql)


_q("agg_bin_contacts", lambda s, c: c, f"SELECT {KEYS}, counts FROM contacts")
_q("agg_bin_cascade", lambda s, c: B.rebin(c, 20000), "SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts WHERE bin_size = 20000", (2500,))
_q("rebin_dynamic", lambda s, c: B.rebin(c, 10000), "SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts WHERE bin_size = 10000", (5000,))
_q("rebin_exact", lambda s, c: B.rebin(B.rebin(c, 5000), 20000), "SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts WHERE bin_size = 20000", (2500,))
BOOK.add(
    "agg_whole_genome",
    lambda s, d: B.whole_genome_contacts(fx.pairs(s, d), fx.chroms(s), bins=100),
    """, g AS (SELECT (pos1 + CASE chr1 WHEN 1 THEN 0 WHEN 2 THEN 200000 ELSE 360000 END) // 1000 // 4 AS a, (pos2 + CASE chr2 WHEN 1 THEN 0 WHEN 2 THEN 200000 ELSE 360000 END) // 1000 // 4 AS b, score FROM pairs)
SELECT CAST(0 AS BIGINT) AS chr1, CAST(0 AS BIGINT) AS chr2, CAST(4 AS BIGINT) AS bin_size, least(a, b) AS bin_x, greatest(a, b) AS bin_y, CAST(sum(score) AS DOUBLE) AS counts FROM g GROUP BY ALL""",
)
_q("flt_min_count", lambda s, c: B.at_least(c, 30), f"SELECT {KEYS}, counts FROM contacts WHERE counts >= 30")
_q(
    "agg_matrix_meta",
    lambda s, c: B.matrix_meta(c),
    """SELECT chr1, chr2, bin_size, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) AS sum_counts, count(*) AS cell_count,
 quantile_disc(counts, 0.05) AS p05, quantile_disc(counts, 0.95) AS p95 FROM contacts GROUP BY ALL""",
)
_q("agg_average_count", lambda s, c: rounded(B.average_counts(c, fx.chroms(s)), "average_count"), "SELECT chr1, chr2, bin_size, round(av, 6) AS average_count FROM avgs")
_REGION = "bin_x * bin_size BETWEEN {} AND {} AND bin_y * bin_size BETWEEN {} AND {}"
_A, _B = _REGION.format(20000, 90000, 60000, 150000), _REGION.format(60000, 150000, 20000, 90000)
BOOK.add("flt_region", lambda s, d: ST.region_of_store(s, shelved(s, d), list(fx.SIZES), 1, 20000, 90000, 1, 60000, 150000), f"SELECT {KEYS}, counts FROM contacts WHERE chr1 = 1 AND chr2 = 1 AND ({_A} OR {_B})")
BOOK.add("q_observed_region", lambda s, d: ST.region_of_store(s, shelved(s, d), 2500, 2, 0, 80000, 1, 10000, 120000), f"SELECT {KEYS}, counts FROM contacts WHERE chr1 = 1 AND chr2 = 2 AND bin_size = 2500 AND " + _REGION.format(10000, 120000, 0, 80000))
_q("q_cell", lambda s, c: c.where("chr1 = 1 and chr2 = 1 and bin_size = 10000 and bin_x = 2 and bin_y = 5"), f"SELECT {KEYS}, counts FROM contacts WHERE chr1 = 1 AND chr2 = 1 AND bin_size = 10000 AND bin_x = 2 AND bin_y = 5")
_q("mat_extract", lambda s, c: B.mirrored(c.where("bin_size = 5000 and chr1 = 1 and chr2 = 1")).where("i between 4 and 15 and j between 8 and 25").select("i", "j", "counts"), "SELECT i, j, counts FROM both_tri WHERE chr = 1 AND bin_size = 5000 AND i BETWEEN 4 AND 15 AND j BETWEEN 8 AND 25")
_q("top_neighbors", lambda s, c: B.top_neighbors(c.where("bin_size = 10000"), 3), """, r AS (SELECT chr, bin_size, i, j, counts, row_number() OVER (PARTITION BY chr, bin_size, i ORDER BY counts DESC, j) AS rank FROM both_tri WHERE bin_size = 10000)
SELECT chr, bin_size, i, j, counts, rank FROM r WHERE rank <= 3""")
_q("srt_records", lambda s, c: c.where("bin_size = 20000").sortWithinPartitions("bin_y", "bin_x"), f"SELECT {KEYS}, counts FROM contacts WHERE bin_size = 20000")
BOOK.add("set_sum_maps", lambda s, d: B.sum_maps([contacts(s, d), contacts(s, d, True)]), f"SELECT {KEYS}, sum(counts) AS counts FROM (SELECT * FROM contacts UNION ALL SELECT * FROM ctrl) GROUP BY ALL")
_q("agg_actual_distance", lambda s, c: E.actual_distance(c), "SELECT bin_size, dist, actual FROM act")
_q("agg_possible_distance", lambda s, c: E.possible_distance(c, fx.chroms(s)), "SELECT bin_size, dist, CAST(possible AS BIGINT) AS possible FROM poss")
_q("agg_expected_raw", lambda s, c: rounded(E.raw_expected(c, fx.chroms(s)), "value"), "SELECT bin_size, dist, round(value, 6) AS value FROM ex")
_q("agg_expected", lambda s, c: rounded(E.smooth_expected(c, fx.chroms(s)), "value"), None)
_q("q_expected_vector", lambda s, c: rounded(E.smooth_expected(c.where("bin_size = 5000"), fx.chroms(s)), "value"), None)
_q(
    "agg_expected_scale",
    lambda s, c: rounded(E.scale_factors(E.raw_expected(c, fx.chroms(s)), c, fx.chroms(s)), "factor"),
    """, tot AS (SELECT bin_size, chr1 AS chr, sum(counts) AS obs FROM contacts WHERE chr1 = chr2 GROUP BY ALL)
SELECT n.bin_size, n.chr, round(sum((n - dist) * value) / any_value(obs), 6) AS factor FROM nbins n JOIN ex e ON e.bin_size = n.bin_size AND dist < n JOIN tot t ON t.bin_size = n.bin_size AND t.chr = n.chr GROUP BY n.bin_size, n.chr""",
)
BOOK.add(
    "agg_expected_merge",
    lambda s, d: rounded(E.merge_expected([E.raw_expected(contacts(s, d), fx.chroms(s)), E.raw_expected(contacts(s, d, True), fx.chroms(s)).where("dist < 30")]), "value"),
    "SELECT bin_size, dist, round(sum(value), 6) AS value FROM (SELECT * FROM ex WHERE dist < 30 UNION ALL SELECT * FROM exc WHERE dist < 30) GROUP BY ALL",
)
_q("join_expected", lambda s, c: rounded(E.with_expected(c, E.raw_expected(c, fx.chroms(s)), B.average_counts(c, fx.chroms(s))).select(*KEYS.split(", "), "expected"), "expected"), f"SELECT {KEYS}, round(e, 6) AS expected FROM one")
_q("agg_row_sums", lambda s, c: N.row_sums(c), "SELECT bin_size, chr, bin, value FROM rowsums")
_q("agg_nonzero_rows", lambda s, c: N.nonzero_rows(c), "SELECT bin_size, chr, i AS bin, count(*) AS cells FROM both_tri GROUP BY ALL")
_qh("agg_sum_factor", lambda s, c: rounded(N.sum_factors(c, N.row_sums(c)), "factor", digits=9), "SELECT bin_size, chr, round(factor, 9) AS factor FROM vcf")
_qh("norm_vc", lambda s, c: rounded(N.vanilla_coverage(c), "value"), "SELECT bin_size, chr, bin, round(value, 6) AS value FROM vc")
_SQRT = """, sq AS (SELECT bin_size, chr, bin, sqrt(value) AS value FROM rowsums),
sn AS (SELECT c.*, counts / (v1.value * v2.value) AS nv FROM contacts c JOIN sq v1 ON v1.bin_size = c.bin_size AND v1.chr = c.chr1 AND v1.bin = bin_x JOIN sq v2 ON v2.bin_size = c.bin_size AND v2.chr = c.chr2 AND v2.bin = bin_y),
sf AS (SELECT bin_size, chr1 AS chr, sqrt(sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * nv) / sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * counts)) AS factor FROM sn WHERE chr1 = chr2 GROUP BY ALL),
vs AS (SELECT q.bin_size, q.chr, bin, value * factor AS value FROM sq q JOIN sf f ON f.bin_size = q.bin_size AND f.chr = q.chr)"""
_qh("norm_vc_sqrt", lambda s, c: rounded(N.vanilla_coverage(c, root=True), "value"), _SQRT + " SELECT bin_size, chr, bin, round(value, 6) AS value FROM vs")
_qh("join_norm_vectors", lambda s, c: rounded(N.compare_vectors(N.vanilla_coverage(c), N.vanilla_coverage(c, root=True)), "a", "b", "ratio"), _SQRT + " SELECT bin_size, chr, bin, round(vc.value, 6) AS a, round(vs.value, 6) AS b, round(vc.value / vs.value, 6) AS ratio FROM vc FULL JOIN vs USING (bin_size, chr, bin)")
_NV = """, nv AS (SELECT c.*, counts / (v1.value * v2.value) AS nvalue FROM contacts c JOIN vc v1 ON v1.bin_size = c.bin_size AND v1.chr = c.chr1 AND v1.bin = bin_x JOIN vc v2 ON v2.bin_size = c.bin_size AND v2.chr = c.chr2 AND v2.bin = bin_y)"""
_qh("join_norm", lambda s, c: rounded(N.normalize(c, N.vanilla_coverage(c)), "counts"), _NV + f" SELECT {KEYS}, round(nvalue, 6) AS counts FROM nv")
_qh("q_norm_vector", lambda s, c: rounded(N.vanilla_coverage(c).where("bin_size = 2500 and chr = 2 and bin between 10 and 30"), "value"), "SELECT bin_size, chr, bin, round(value, 6) AS value FROM vc WHERE bin_size = 2500 AND chr = 2 AND bin BETWEEN 10 AND 30")
_qh("agg_matrix_sum", lambda s, c: rounded(N.matrix_sums(c, N.vanilla_coverage(c)), "norm_sum"), _NV + " SELECT bin_size, chr1 AS chr, round(sum(nvalue), 6) AS norm_sum, sum(counts) AS raw_sum, count(*) AS valid_cells FROM nv WHERE chr1 = chr2 GROUP BY ALL")
_qh("norm_expected", lambda s, c: rounded(E.actual_distance(N.normalize(c, N.vanilla_coverage(c))), "actual"), _NV + " SELECT bin_size, bin_y - bin_x AS dist, round(sum(nvalue), 6) AS actual FROM nv WHERE chr1 = chr2 GROUP BY ALL")
_qh("mat_spmv", lambda s, c: rounded(N.spmv(c, N.row_sums(c)), "value"), "SELECT b.bin_size, b.chr, i AS bin, round(sum(counts * value), 6) AS value FROM both_tri b JOIN rowsums r ON r.bin_size = b.bin_size AND r.chr = b.chr AND r.bin = j GROUP BY ALL")
_qh("q_norm2", lambda s, c: rounded(V.inverse_norm(c, N.vanilla_coverage(c)), "value", digits=9), f", w AS (SELECT c.*, 1 / (v1.value * v2.value * pow(greatest(1, abs(bin_x - bin_y)), 4)) AS w FROM contacts c JOIN vc v1 ON v1.bin_size = c.bin_size AND v1.chr = c.chr1 AND v1.bin = bin_x JOIN vc v2 ON v2.bin_size = c.bin_size AND v2.chr = c.chr2 AND v2.bin = bin_y WHERE c.chr1 = c.chr2) SELECT {KEYS}, round(w, 9) AS value FROM w")

# Views of one map and of two.
_LN = "ln({} + 1)"
_ONE_SQL = {
    "q_observed": "o", "q_expected": "e", "q_oe": "o / e", "q_oe_p1": "(o + 1) / (e + 1)", "q_log": "ln(1 + o)",
    "q_logeo": "ln(o + 1) / ln(e + 1)", "q_explogeo": "exp(ln(o + 1) / ln(e + 1))",
}
_TWO_SQL = {
    "q_control": "c", "q_logratio": "ln(o / a + 1) / ln(c / ac + 1)", "q_logeoratio": "(ln(o + 1) / ln(e + 1)) / (ln(c + 1) / ln(ec + 1))",
    "q_diff": "(o / a - c / ac) * (a + ac) / 2", "q_logceo": "ln(c + 1) / ln(ec + 1)", "q_explogceo": "exp(ln(c + 1) / ln(ec + 1))",
    "q_ratio": "(o / a) / (c / ac)", "q_ratio_p1": "((o + 1) / (a + 1)) / ((c + 1) / (ac + 1))",
    "q_ratio0": "(o / e0) / (c / ec0)", "q_ratio0_p1": "((o + 1) / (e0 + 1)) / ((c + 1) / (ec0 + 1))",
    "q_oeratio": "(o / e) / (c / ec)", "q_oeratio_p1": "((o + 1) / (e + 1)) / ((c + 1) / (ec + 1))",
    "q_oeratio_minus": "o / e - c / ec", "q_oeratio_minus_p1": "(o + 1) / (e + 1) - (c + 1) / (ec + 1)",
}
_FINITE = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"


def _two(s, d):
    return V.two_maps(held(s, d), held(s, d, True), fx.chroms(s))


for _name, _sql in _ONE_SQL.items():
    BOOK.add(_name, lambda s, d, n=_name: rounded(V.view(V.one_map(held(s, d), fx.chroms(s)), V.one_map_views()[n]), "value"), f"SELECT {KEYS}, round(value, 6) AS value FROM (SELECT *, {_sql} AS value FROM one) WHERE {_FINITE}")
for _name, _sql in _TWO_SQL.items():
    BOOK.add(_name, lambda s, d, n=_name: rounded(V.view(_two(s, d), V.two_map_views()[n]), "value"), f"SELECT {KEYS}, round(value, 6) AS value FROM (SELECT *, {_sql} AS value FROM two) WHERE {_FINITE}")
_VS_SQL = {
    "q_vs": ("o / a * ((a + ac) / 2)", "c / ac * ((a + ac) / 2)"), "q_logvs": ("ln(o / a * ((a + ac) / 2) + 1)", "ln(c / ac * ((a + ac) / 2) + 1)"),
    "q_oevs": ("o / e", "c / ec"), "q_oevs_p1": ("(o + 1) / (e + 1)", "(c + 1) / (ec + 1)"), "q_ocmevs": ("o - e", "c - ec"),
    "q_logeovs": ("ln(o + 1) / ln(e + 1)", "ln(c + 1) / ln(ec + 1)"),
}
for _name, (_up, _low) in _VS_SQL.items():
    BOOK.add(
        _name,
        lambda s, d, n=_name: rounded(V.versus(_two(s, d), V.two_map_views()[f"{n}_upper"], V.two_map_views()[f"{n}_lower"]), "value"),
        f"""SELECT chr, bin_size, i, j, round(value, 6) AS value FROM (SELECT chr1 AS chr, bin_size, bin_x AS i, bin_y AS j, {_up} AS value FROM two WHERE chr1 = chr2
        UNION ALL SELECT chr1, bin_size, bin_y, bin_x, {_low} FROM two WHERE chr1 = chr2 AND bin_x <> bin_y) WHERE {_FINITE}""",
    )


def _expected_windows(s, d):
    """Every cell of two windows, one inside a chromosome and one between two."""
    cells = held(s, d, sizes=(2500,))
    expected, averages = E.raw_expected(cells, fx.chroms(s)), B.average_counts(cells, fx.chroms(s))
    part = lambda *w: V.expected_window(fx.chroms(s), expected, averages, 2500, *w)
    return rounded(part(1, 20000, 150000, 1, 0, 10**9).unionByName(part(1, 0, 60000, 2, 100000, 10**9)), "value")


BOOK.add("q_expected_window", _expected_windows, """, w AS (SELECT CAST(1 AS BIGINT) AS chr1, CAST(1 AS BIGINT) AS chr2, x.i AS bin_x, y.j AS bin_y FROM range(8, 61) x(i), range(0, 80) y(j)
 UNION ALL SELECT 1, 2, x.i, y.j FROM range(0, 25) x(i), range(40, 64) y(j))
SELECT w.chr1, w.chr2, CAST(2500 AS BIGINT) AS bin_size, bin_x, bin_y, round(CASE WHEN w.chr1 = w.chr2 THEN e.value WHEN av > 0 THEN av ELSE 1 END, 6) AS value FROM w JOIN lastd l ON l.bin_size = 2500
 LEFT JOIN ex e ON e.bin_size = 2500 AND e.dist = least(abs(bin_y - bin_x), last) LEFT JOIN avgs v ON v.chr1 = w.chr1 AND v.chr2 = w.chr2 AND v.bin_size = 2500""")
BOOK.add("join_control", lambda s, d: contacts(s, d).join(contacts(s, d, True).withColumnRenamed("counts", "control"), KEYS.split(", ")), f"SELECT {KEYS}, o AS counts, c AS control FROM two")


def _oe_region(s, d):
    path = shelved(s, d)
    cells = ST.region_of_store(s, path, list(fx.SIZES), 1, 0, 100000, 1, 0, 100000)
    return rounded(V.view(V.one_map(cells, fx.chroms(s), ST.read_store(s, path)), V.one_map_views()["q_oe"]), "value")


BOOK.add("q_oe_region", _oe_region, f"SELECT {KEYS}, round(o / e, 6) AS value FROM one WHERE chr1 = 1 AND chr2 = 1 AND bin_x * bin_size <= 100000 AND bin_y * bin_size <= 100000 AND e <> 0")


def entry_region_oe(s, d):
    """Pairs of quality 10 and more, binned at 2500, coverage-normalised, over the mean at each distance, in one region."""
    from plectra.operators.pairs import min_mapq

    cells = stored(B.bin_contacts(min_mapq(fx.pairs(s, d), 10), [2500]).where("chr1 = 1 and chr2 = 1"))
    normed = N.normalize(cells, N.vanilla_coverage(cells))
    means = normed.groupBy((F.col("bin_y") - F.col("bin_x")).alias("dist")).agg(F.avg("counts").alias("mean"))
    oe = normed.withColumn("dist", F.col("bin_y") - F.col("bin_x")).join(F.broadcast(means), "dist")
    view = B.region(oe.select(*KEYS.split(", "), ieee_div("counts", "mean").alias("value")), 1, 0, 120000, 1, 0, 120000, 2500)
    return rounded(view, "value")


BOOK.add("entry_region_oe", entry_region_oe, f""", k AS (SELECT chr1, chr2, bin_size, bin_x, bin_y, CAST(sum(score) AS DOUBLE) AS counts FROM (SELECT b.* FROM (SELECT chr1, chr2, CAST(2500 AS BIGINT) AS bin_size,
  least(pos1 // 2500, pos2 // 2500) AS bin_x, greatest(pos1 // 2500, pos2 // 2500) AS bin_y, score FROM flip WHERE chr1 = 1 AND chr2 = 1 AND least(mapq1, mapq2) >= 10) b) GROUP BY ALL),
kt AS (SELECT bin_x AS i, counts FROM k UNION ALL SELECT bin_y, counts FROM k WHERE bin_x <> bin_y), kr AS (SELECT i, sum(counts) AS v FROM kt GROUP BY i),
kn AS (SELECT k.*, counts / (a.v * b.v) AS n FROM k JOIN kr a ON a.i = bin_x JOIN kr b ON b.i = bin_y),
kf AS (SELECT sqrt(sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * n) / sum(CASE WHEN bin_x <> bin_y THEN 2 ELSE 1 END * counts)) AS f FROM kn),
km AS (SELECT kn.*, n / (f * f) AS nn FROM kn, kf), kd AS (SELECT bin_y - bin_x AS d, avg(nn) AS m FROM km GROUP BY ALL)
SELECT {KEYS}, round(nn / m, 6) AS value FROM km JOIN kd ON d = bin_y - bin_x WHERE bin_x * 2500 <= 120000 AND bin_y * 2500 <= 120000""")

# Tracks of maps, windows over vectors, genome-wide forms.
_q("trk_coverage", lambda s, c: rounded(T.coverage(N.vanilla_coverage(c.where("bin_size = 2500")), fx.chroms(s), 2500), "value"), ", ab AS (SELECT idx AS chr, unnest(range(0, (len - 1) // 2500 + 1)) AS bin FROM chroms) SELECT ab.chr, ab.bin, round(coalesce(value, 0), 6) AS value FROM ab LEFT JOIN vc ON vc.chr = ab.chr AND vc.bin = ab.bin AND vc.bin_size = 2500")
_q("trk_crosshair", lambda s, c: T.crosshair(c, fx.chroms(s), 1, 12, 2500), ", ab AS (SELECT idx AS chr, unnest(range(0, (len - 1) // 2500 + 1)) AS bin FROM chroms WHERE idx = 1) SELECT ab.chr, ab.bin, coalesce(counts, 0) AS value FROM ab LEFT JOIN both_tri t ON t.chr = 1 AND t.bin_size = 2500 AND t.i = 12 AND t.j = ab.bin")
_q("win_sliding_avg", lambda s, c: rounded(T.sliding_average(N.row_sums(c).where("bin_size = 5000"), 3), "value"), "SELECT chr, bin, round(avg(value) OVER (PARTITION BY chr ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS value FROM rowsums WHERE bin_size = 5000")
_q("win_reverse_cumsum", lambda s, c: T.reverse_cumulative(N.row_sums(c).where("bin_size = 5000")), "SELECT chr, bin, sum(value) OVER (PARTITION BY chr ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS value FROM rowsums WHERE bin_size = 5000")
_q("win_rank_percentile", lambda s, c: rounded(T.rank_percentile(c, ["chr1", "chr2", "bin_size"]), "percentile").select(*KEYS.split(", "), "percentile"), f"SELECT {KEYS}, round((rank() OVER (PARTITION BY chr1, chr2, bin_size ORDER BY counts) - 1) * 100.0 / count(*) OVER (PARTITION BY chr1, chr2, bin_size), 6)::DOUBLE AS percentile FROM contacts")
_q("color_percentile", lambda s, c: c.where("bin_x <> bin_y").groupBy("chr1", "chr2", "bin_size").agg(F.round(F.percentile("counts", 0.95), 6).alias("p95")), "SELECT chr1, chr2, bin_size, round(quantile_cont(counts, 0.95), 6) AS p95 FROM contacts WHERE bin_x <> bin_y GROUP BY ALL")
_OFF = """, gb AS (SELECT bin_size, idx, coalesce(sum(len // bin_size + 1) OVER (PARTITION BY bin_size ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM chroms, (SELECT CAST(unnest([2500,5000,10000,20000]) AS BIGINT) AS bin_size))"""
_q("genome_wide_assembly", lambda s, c: N.offset_contacts(c, fx.chroms(s)), _OFF + " SELECT CAST(0 AS BIGINT) AS chr1, CAST(0 AS BIGINT) AS chr2, c.bin_size, bin_x + a.o AS bin_x, bin_y + b.o AS bin_y, counts FROM contacts c JOIN gb a ON a.bin_size = c.bin_size AND a.idx = chr1 JOIN gb b ON b.bin_size = c.bin_size AND b.idx = chr2")
_qh("q_genome_wide", lambda s, c: rounded(N.split_vector(N.vanilla_coverage(N.offset_contacts(c.where("bin_size = 10000"), fx.chroms(s))), fx.chroms(s)), "value"), _OFF + """, gc AS (SELECT bin_x + a.o AS x, bin_y + b.o AS y, counts FROM contacts c JOIN gb a ON a.bin_size = c.bin_size AND a.idx = chr1 JOIN gb b ON b.bin_size = c.bin_size AND b.idx = chr2 WHERE c.bin_size = 10000),
gr AS (SELECT i, sum(counts) AS v FROM (SELECT x AS i, counts FROM gc UNION ALL SELECT y, counts FROM gc WHERE x <> y) GROUP BY i),
gf AS (SELECT sqrt(sum(CASE WHEN x <> y THEN 2 ELSE 1 END * counts / (a.v * b.v)) / sum(CASE WHEN x <> y THEN 2 ELSE 1 END * counts)) AS f FROM gc JOIN gr a ON a.i = x JOIN gr b ON b.i = y)
SELECT gb.bin_size, gb.idx AS chr, i - o AS bin, round(v * f, 6) AS value FROM gr CROSS JOIN gf JOIN gb ON gb.bin_size = 10000 JOIN chroms ON chroms.idx = gb.idx WHERE i >= o AND i < o + len // 10000 + 1""")
