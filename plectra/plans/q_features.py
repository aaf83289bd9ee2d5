"""Queries on rectangles and aggregate peak analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import apa as A
from plectra.operators import binning as B
from plectra.operators import features2d as X
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded

BOOK = Book()
C = "chr1, start1, end1, chr2, start2, end2"
_DA = f", da AS (SELECT DISTINCT {C} FROM feat_a), db AS (SELECT DISTINCT {C} FROM feat_b)"
_COORDS = ("start1", "end1", "start2", "end2")


def _near(tol: int) -> str:
    return "a.chr1 = b.chr1 AND a.chr2 = b.chr2 AND " + " AND ".join(f"abs(a.{c} - b.{c}) <= {tol}" for c in _COORDS)


def _q(name, f, sql):
    def run(s, d):
        return f(s, fx.feat_a(s, d).select(*X.COORDS), fx.feat_b(s, d).select(*X.COORDS))

    BOOK.add(name, run, None if sql is None else _DA + "\n" + sql)


def _half(x, i):
    return f"(({x}.end{i} - {x}.start{i}) // 2)"


def _over(a, b):
    return f"{a}.chr1 = {b}.chr1 AND {a}.chr2 = {b}.chr2 AND " + " AND ".join(
        f"({a}.start{i} + {a}.end{i}) // 2 BETWEEN {b}.start{i} - {_half(b, i)} AND {b}.end{i} + {_half(b, i)}" for i in (1, 2)
    )


_q("f2d_intersection", lambda s, a, b: X.intersection(a, b, 1000), f"SELECT {C} FROM da a WHERE EXISTS (SELECT 1 FROM db b WHERE {_near(1000)})")
_q("f2d_intersection_exact", lambda s, a, b: X.intersection(a, b), f"SELECT {C} FROM da INTERSECT SELECT {C} FROM db")
_q("f2d_subtract", lambda s, a, b: X.subtract(a, b, 1000), f"SELECT {C} FROM da a WHERE NOT EXISTS (SELECT 1 FROM db b WHERE {_near(1000)})")
_q("f2d_symdiff", lambda s, a, b: X.symmetric_difference(a, b, 500), f"SELECT {C}, 'A' AS parent_list FROM da a WHERE NOT EXISTS (SELECT 1 FROM db b WHERE {_near(500)}) UNION ALL SELECT {C}, 'B' FROM db a WHERE NOT EXISTS (SELECT 1 FROM da b WHERE {_near(500)})")
_q("f2d_overlap", lambda s, a, b: X.overlapping(b, a), f"SELECT {C} FROM db x WHERE EXISTS (SELECT 1 FROM da y WHERE {_over('x', 'y')})")
_q("f2d_add_unique", lambda s, a, b: X.add_unique(a.where("start1 < 60000"), b), f"SELECT {C} FROM da WHERE start1 < 60000 UNION ALL SELECT {C} FROM db x WHERE NOT EXISTS (SELECT 1 FROM da y WHERE y.start1 < 60000 AND {_over('x', 'y')})")
_R2 = "a.chr1 = b.chr1 AND a.chr2 = b.chr2 AND pow(a.start1 - b.start1, 2) + pow(a.start2 - b.start2, 2) <= pow(1500, 2)"
_q("f2d_reproducible", lambda s, a, b: X.reproducible(a, b, 1500), f"SELECT {C} FROM db b WHERE EXISTS (SELECT 1 FROM da a WHERE {_R2})")
_q("f2d_reproducible_frac", lambda s, a, b: X.reproducible(a, b, 1500, 0.05), f"SELECT {C} FROM (SELECT b.*, min(sqrt(pow(a.start1 - b.start1, 2) + pow(a.start2 - b.start2, 2))) AS d FROM db b JOIN da a ON {_R2} GROUP BY ALL) WHERE d <= 0.05 * (start2 - start1)")
_q("f2d_near_centroids", lambda s, a, b: X.near_centroids(b, a), f"SELECT {C} FROM feat_b b WHERE EXISTS (SELECT 1 FROM da a WHERE a.chr1 = b.chr1 AND a.chr2 = b.chr2 AND a.start1 = b.start1 AND a.start2 = b.start2)")
_q("f2d_not_near_centroids", lambda s, a, b: X.near_centroids(b, a, keep=False), f"SELECT {C} FROM feat_b b WHERE NOT EXISTS (SELECT 1 FROM da a WHERE a.chr1 = b.chr1 AND a.chr2 = b.chr2 AND a.start1 = b.start1 AND a.start2 = b.start2)")


def _domains(a):
    return a.select("chr1", "start1", (F.col("start2") + 1000).alias("end1"), "chr2", F.col("start1").alias("start2"), (F.col("start2") + 1000).alias("end2"))


_q("f2d_loop_domain", lambda s, a, b: X.loop_domains(_domains(a), b, 4000), f", dm AS (SELECT DISTINCT chr1, start1, start2 + 1000 AS end1, chr2, start1 AS start2, start2 + 1000 AS end2 FROM da), lp AS (SELECT chr1, chr2, (start1 + end1) // 2 AS m1, (start2 + end2) // 2 AS m2 FROM db) SELECT {C} FROM dm WHERE EXISTS (SELECT 1 FROM lp WHERE lp.chr1 = dm.chr1 AND lp.chr2 = dm.chr2 AND abs(m1 - dm.start1) <= 4000 AND abs(m2 - dm.end1) <= 4000)")
_q("set_compare_lists", lambda s, a, b: X.compare_lists(a, b, 1000), f""", com AS (SELECT {C} FROM da INTERSECT SELECT {C} FROM db), ra AS (SELECT {C} FROM da EXCEPT SELECT {C} FROM db), rb AS (SELECT {C} FROM db EXCEPT SELECT {C} FROM da)
SELECT {C}, 'common' AS class FROM com UNION ALL SELECT {C}, CASE WHEN EXISTS (SELECT 1 FROM db b WHERE {_near(1000)}) THEN 'A' ELSE 'A*' END FROM ra a UNION ALL SELECT {C}, CASE WHEN EXISTS (SELECT 1 FROM da b WHERE {_near(1000)}) THEN 'B' ELSE 'B*' END FROM rb a""")
_q("set_intersect_n", lambda s, a, b: X.intersect_all([a, b, a.where("start1 > 20000")], 2000), f", ab AS (SELECT {C} FROM da a WHERE EXISTS (SELECT 1 FROM db b WHERE {_near(2000)})) SELECT {C} FROM ab a WHERE EXISTS (SELECT 1 FROM (SELECT * FROM da WHERE start1 > 20000) b WHERE {_near(2000)})")
_q("set_union_features", lambda s, a, b: a.unionByName(b), f"SELECT {C} FROM feat_a UNION ALL SELECT {C} FROM feat_b")
_q("srt_features", lambda s, a, b: X.distinct(a).orderBy("chr1", "chr2", "start1", "start2", "end1", "end2"), f"SELECT {C} FROM da")
_q("rt_intersects", lambda s, a, b: X.window_hits(b, 1, 20000, 60000, 1, 40000, 100000), f"SELECT {C} FROM feat_b WHERE chr1 = 1 AND chr2 = 1 AND start1 <= 60000 AND end1 >= 20000 AND start2 <= 100000 AND end2 >= 40000")
_q("rt_contains", lambda s, a, b: X.window_hits(b, 1, 20000, 60000, 1, 40000, 100000, inside=True), f"SELECT {C} FROM feat_b WHERE chr1 = 1 AND chr2 = 1 AND start1 >= 20000 AND end1 <= 60000 AND start2 >= 40000 AND end2 <= 100000")
_q("rt_nearest_n", lambda s, a, b: rounded(X.nearest(b, 1, 1, 31000, 72000, 5), "distance"), f"SELECT {C}, round(sqrt(pow(greatest(start1 - 31000, 0, 31000 - end1), 2) + pow(greatest(start2 - 72000, 0, 72000 - end2), 2)), 6) AS distance FROM db WHERE chr1 = 1 AND chr2 = 1 ORDER BY distance, chr1, start1, end1, chr2, start2, end2 LIMIT 5")
_q("flt_feature_size", lambda s, a, b: X.in_size_band(b, 5000, 3, 8), f"SELECT {C} FROM feat_b WHERE floor(abs((start1 + end1) // 2 - (start2 + end2) // 2) / 5000.0 + 0.5) BETWEEN 3 AND 8")
_q("flt_near_diag", lambda s, a, b: X.off_diagonal(a, 20000), f"SELECT {C} FROM feat_a WHERE abs(start1 - start2) >= 20000")
BOOK.add("flt_strong", lambda s, d: fx.feat_a(s, d).where("observed > 950").select(*X.COORDS, "observed"), f"SELECT {C}, observed FROM feat_a WHERE observed > 950")
BOOK.add(
    "flt_attr_value",
    lambda s, d: fx.feat_a(s, d).withColumn("attributes", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("key"), (F.col("p_partkey") % 7).cast("string"))).where(F.array_contains(F.map_values("attributes"), "3")).select(*X.COORDS, "p_size"),
    f"SELECT {C}, p_size FROM feat_a WHERE p_size = 3 OR p_partkey % 7 = 3",
)
BOOK.add(
    "agg_convergence_hist",
    lambda s, d: X.convergence(fx.feat_a(s, d).select(F.expr("if(p_partkey % 5 = 0, null, p_partkey % 2 = 0)").alias("strand1"), F.expr("p_partkey % 3 = 0").alias("strand2"), F.expr("p_partkey % 7 <> 0").alias("unique1"), F.expr("p_partkey % 11 <> 0").alias("unique2"))),
    "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'incomplete' WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'non-unique' ELSE (CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END) || (CASE WHEN p_partkey % 3 = 0 THEN '+' ELSE '-' END) END AS status, count(*) AS n FROM feat_a GROUP BY ALL",
)

# Aggregate peak analysis at 2500 bases a bin, windows of 11 bins.
_HALF, _CORNER = 5, 3


def _windows(s, d):
    return A.windows(B.bin_contacts(fx.pairs(s, d), [2500]), fx.feat_a(s, d), 2500, _HALF)


_W = f""", md AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 2500 AS m1, ((start2 + end2) // 2) // 2500 AS m2 FROM feat_a),
wn AS (SELECT c.chr1, c.chr2, m1, m2, bin_x - m1 + {_HALF} AS i, bin_y - m2 + {_HALF} AS j, counts FROM contacts c JOIN md ON c.chr1 = md.chr1 AND c.chr2 = md.chr2 AND bin_size = 2500 AND abs(bin_x - m1) <= {_HALF} AND abs(bin_y - m2) <= {_HALF})"""
_ST = f""", per AS (SELECT chr1, chr2, m1, m2, greatest(1.0, sum(counts) / {(2 * _HALF + 1) ** 2}.0) AS mean, max(CASE WHEN i = {_HALF} AND j = {_HALF} THEN counts END) AS centre, min(CASE WHEN counts > 0 THEN counts END) AS least FROM wn GROUP BY ALL),
rk AS (SELECT *, CASE WHEN counts > 0 THEN ({(2 * _HALF + 1) ** 2} - count(*) FILTER (counts > 0) OVER f + (SELECT count(*) FROM wn o WHERE o.chr1 = w.chr1 AND o.chr2 = w.chr2 AND o.m1 = w.m1 AND o.m2 = w.m2 AND o.counts > 0 AND o.counts < w.counts)) * 100.0 / {(2 * _HALF + 1) ** 2} ELSE 0 END AS rank
 FROM wn w WINDOW f AS (PARTITION BY chr1, chr2, m1, m2)),
su AS (SELECT i, j, sum(rank) AS ranked, sum(counts) AS raw, sum(counts / mean) AS mean_normed, sum(counts / coalesce(CASE WHEN centre > 0 THEN centre END, least, 1.0)) AS centre_normed FROM rk JOIN per USING (chr1, chr2, m1, m2) GROUP BY ALL),
pl AS (SELECT i, j FROM range(0, {2 * _HALF + 1}) a(i), range(0, {2 * _HALF + 1}) b(j)), sk AS (SELECT pl.i, pl.j, coalesce(raw, 0) AS raw, coalesce(mean_normed, 0) AS mean_normed, coalesce(centre_normed, 0) AS centre_normed, coalesce(ranked, 0) AS ranked FROM pl LEFT JOIN su ON su.i = pl.i AND su.j = pl.j)"""
BOOK.add("apa_extract", _windows, _W + " SELECT chr1, chr2, m1, m2, i, j, counts FROM wn")
BOOK.add("apa_stack", lambda s, d: rounded(A.stack(_windows(s, d), _HALF), "raw", "mean_normed", "centre_normed", "ranked"), _W + _ST + " SELECT i, j, round(raw, 6) AS raw, round(mean_normed, 6) AS mean_normed, round(centre_normed, 6) AS centre_normed, round(ranked, 6) AS ranked FROM sk")
_LAST = 2 * _HALF + 1 - _CORNER
BOOK.add(
    "apa_stats",
    lambda s, d: rounded(A.region_statistics(A.stack(_windows(s, d), _HALF), _HALF, _CORNER), "p2m", "p2ul", "p2ur", "p2ll", "p2lr", "z_ll"),
    _W + _ST + f""", rs AS (SELECT max(CASE WHEN i = {_HALF} AND j = {_HALF} THEN raw END) AS c, sum(raw) AS t, avg(CASE WHEN i < {_CORNER} AND j < {_CORNER} THEN raw END) AS ul, avg(CASE WHEN i < {_CORNER} AND j >= {_LAST} THEN raw END) AS ur,
 avg(CASE WHEN i >= {_LAST} AND j < {_CORNER} THEN raw END) AS ll, avg(CASE WHEN i >= {_LAST} AND j >= {_LAST} THEN raw END) AS lr, stddev_samp(CASE WHEN i >= {_LAST} AND j < {_CORNER} THEN raw END) AS sd FROM sk)
SELECT round(c / ((t - c) / {(2 * _HALF + 1) ** 2 - 1}), 6) AS p2m, round(c / ul, 6) AS p2ul, round(c / ur, 6) AS p2ur, round(c / ll, 6) AS p2ll, round(c / lr, 6) AS p2lr, round((c - ll) / sd, 6) AS z_ll FROM rs""",
)
BOOK.add(
    "apa_vs_distance",
    lambda s, d: rounded(A.by_distance(B.bin_contacts(fx.pairs(s, d), [2500]), fx.feat_a(s, d), 2500, _HALF, _CORNER), "p2ll"),
    _W + f""", bk AS (SELECT *, CAST(least(7, greatest(0, floor(log2(greatest(abs(m2 - m1), 1))))) AS BIGINT) AS bucket FROM wn), bs AS (SELECT bucket, count(DISTINCT (chr1, chr2, m1, m2)) AS features, sum(CASE WHEN i = {_HALF} AND j = {_HALF} THEN counts ELSE 0 END) AS c,
 sum(CASE WHEN i >= {_LAST} AND j < {_CORNER} THEN counts ELSE 0 END) / {_CORNER**2} AS ll FROM bk GROUP BY bucket) SELECT bucket, features, round(CASE WHEN ll = 0 THEN CASE WHEN c = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE c / ll END, 6) AS p2ll FROM bs""",
)
BOOK.add("afa_extract", lambda s, d: A.windows(B.bin_contacts(fx.pairs(s, d), [2500]), fx.feat_a(s, d).withColumns({"end1": F.col("start1"), "end2": F.col("start2")}), 2500, 2), f""", md AS (SELECT DISTINCT chr1, chr2, start1 // 2500 AS m1, start2 // 2500 AS m2 FROM feat_a)
SELECT c.chr1, c.chr2, m1, m2, bin_x - m1 + 2 AS i, bin_y - m2 + 2 AS j, counts FROM contacts c JOIN md ON c.chr1 = md.chr1 AND c.chr2 = md.chr2 AND bin_size = 2500 AND abs(bin_x - m1) <= 2 AND abs(bin_y - m2) <= 2""")
