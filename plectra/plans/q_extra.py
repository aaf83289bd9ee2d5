"""Queries of motifs, triples, element-wise matrices, resampled windows, matrix files, and checks of a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import apa as A
from plectra.operators import binning as B
from plectra.operators import elementwise as W
from plectra.operators import intervals as I
from plectra.operators import motifs as MO
from plectra.operators import balancing
from plectra.operators import norm as N
from plectra.operators import tracks as T
from plectra.operators import triples as TR
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded
from plectra.plans.q_intervals import _MERGED
from plectra.plans.q_maps import contacts, held
from plectra.plans.storage import stored
from plectra.sources import features_text as T1

BOOK = Book()


# Motifs: anchors are the first thousand bases of both ends of the features, peaks the best event of each cell of ends.
def _anchors(s, d):
    ends = {f"end{k}": F.col(f"start{k}") + 1000 for k in (1, 2)}
    return MO.loop_anchors(fx.feat_a(s, d).withColumns(ends), 1500)


def _motif_list(s, d):
    return fx.loci_a(s, d).select("chr", "x1", "x2", "score", (F.col("x1") % 2 == 0).alias("strand")).distinct()


def _peaks(s, d, size=1250):
    return I.best_in_bin(fx.loci_a(s, d), size)


_ANCHORS = (
    """, ends AS (SELECT DISTINCT chr1 AS chr, start1 AS x1, start1 + 1000 AS x2, true AS first FROM feat_a UNION SELECT DISTINCT chr2, start2, start2 + 1000, false FROM feat_a)"""
    + _MERGED.format("ends")
    + """, anc AS (SELECT m.chr, m.x1 - 250 AS x1, m.x2 + 250 AS x2, bool_or(first) AS upstream, bool_or(NOT first) AS downstream FROM mg m JOIN ends e ON e.chr = m.chr AND m.x1 <= e.x2 AND e.x1 <= m.x2 GROUP BY m.chr, m.x1, m.x2),
motif AS (SELECT DISTINCT chr, x1, x2, score, x1 % 2 = 0 AS strand FROM loci_a),
peak AS (SELECT chr, x1, x2, score FROM (SELECT *, row_number() OVER (PARTITION BY chr, x1 // 1250, x2 // 1250 ORDER BY score DESC, x1, x2) AS r FROM loci_a) WHERE r = 1),
cn AS (SELECT a.chr, a.x1 AS a1, a.x2 AS a2, upstream, downstream, p.x1, p.x2, count(*) OVER (PARTITION BY a.chr, a.x1, a.x2) AS n FROM anc a JOIN peak p ON a.chr = p.chr AND a.x1 <= p.x2 AND p.x1 <= a.x2)"""
)
_BEST = """(SELECT s.chr, s.x1 AS b1, s.x2 AS b2, m.x1, m.x2, m.score, m.strand, row_number() OVER (PARTITION BY s.chr, s.x1, s.x2 ORDER BY m.score DESC, m.x1, m.x2) AS r
 FROM {} s JOIN motif m ON s.chr = m.chr AND m.score > 0 AND m.x1 <= s.x2 AND s.x1 <= m.x2)"""
BOOK.add(
    "motif_unique",
    lambda s, d: MO.unique_motifs(_anchors(s, d), _peaks(s, d, 5000), [fx.loci_b(s, d), I.common(fx.loci_a(s, d), fx.loci_b(s, d))], _motif_list(s, d)),
    _ANCHORS.replace("1250", "5000") + f""", site AS (SELECT DISTINCT chr, x1, x2 FROM cn WHERE n = 1 AND EXISTS (SELECT 1 FROM loci_b b WHERE b.chr = cn.chr AND b.x1 <= cn.x2 AND cn.x1 <= b.x2)
 AND EXISTS (SELECT 1 FROM loci_a a JOIN loci_b b ON a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2 WHERE a.chr = cn.chr AND greatest(a.x1, b.x1) <= cn.x2 AND cn.x1 <= least(a.x2, b.x2)))
SELECT DISTINCT chr, x1, x2, score, strand FROM {_BEST.format("site")} WHERE r = 1""",
)
BOOK.add(
    "motif_inferred",
    lambda s, d: MO.inferred_motifs(_anchors(s, d), _peaks(s, d), _motif_list(s, d)),
    _ANCHORS + "".join(
        f""", {k}site AS (SELECT DISTINCT chr, x1, x2 FROM cn WHERE n > 1 AND {side} AND upstream <> downstream), {k}best AS (SELECT DISTINCT chr, x1, x2, score, strand FROM {_BEST.format(f"{k}site")} WHERE r = 1 AND strand = {forward}),
{k}hit AS (SELECT a.chr, a.x1 AS a1, a.x2 AS a2, b.x1, b.x2, b.score, b.strand, count(*) OVER (PARTITION BY a.chr, a.x1, a.x2) AS n FROM anc a JOIN {k}best b ON a.chr = b.chr AND a.x1 <= b.x2 AND b.x1 <= a.x2 WHERE {side} AND upstream <> downstream)"""
        for k, side, forward in (("u", "upstream", "true"), ("d", "downstream", "false"))
    ) + "\nSELECT chr, a1, a2, x1, x2, score, strand FROM (SELECT * FROM uhit UNION ALL SELECT * FROM dhit) WHERE n = 1",
)
BOOK.add(
    "motif_update",
    lambda s, d: MO.better_motif(_anchors(s, d), _motif_list(s, d)),
    _ANCHORS + """ SELECT chr, a1, a2, x1, x2, score, strand FROM (SELECT a.chr, a.x1 AS a1, a.x2 AS a2, m.x1, m.x2, m.score, m.strand, row_number() OVER (PARTITION BY a.chr, a.x1, a.x2 ORDER BY m.score DESC, m.x1, m.x2) AS r
 FROM anc a JOIN motif m ON a.chr = m.chr AND m.x1 <= a.x2 AND a.x1 <= m.x2) WHERE r = 1""",
)


# Triples: a pair's two positions and a third one made from them.
def _triple_rows(s, d):
    p = "array_sort(array(pos1, pos2, (pos1 * 31 + pos2 * 17) % 120000))"
    return fx.pairs(s, d).where("chr1 = chr2").selectExpr("chr1 AS chr", f"{p} AS p").selectExpr("chr", "p[0] AS x1", "p[1] AS x2", "p[2] AS x3")


_TRIPLES = ", tr AS (SELECT chr1 AS chr, list_sort([pos1, pos2, (pos1 * 31 + pos2 * 17) % 120000]) AS p FROM pairs WHERE chr1 = chr2)"
BOOK.add("triples_search", lambda s, d: TR.dense_cubes(TR.without_duplicates(_triple_rows(s, d)), 5000, 2))
BOOK.add(
    "triples_cubes",
    lambda s, d: TR.dense_cubes(_triple_rows(s, d), 5000, 2),
    _TRIPLES + """, cu AS (SELECT chr, c1, c2, c3, count(*) AS n FROM (SELECT chr, p[1] // 5000 AS c1, p[2] // 5000 AS c2, p[3] // 5000 AS c3 FROM tr) WHERE c2 - c1 > 2 AND c3 - c2 > 2 GROUP BY ALL)
SELECT chr, c1, c2, c3, n FROM cu JOIN (SELECT chr, greatest(2 * max(n) // 3, 2 * min(n)) AS lim FROM cu GROUP BY chr) USING (chr) WHERE n > lim""",
)

# Column sums over all chromosomes.
_COLUMNS = """, cs AS (SELECT chr, bin, sum(counts) AS value, max(diag) AS diagonal FROM (SELECT chr, i AS bin, counts, CASE WHEN i = j THEN counts END AS diag FROM both_tri WHERE bin_size = 5000
 UNION ALL SELECT chr1, bin_x, counts, NULL FROM contacts WHERE chr1 <> chr2 AND bin_size = 5000 UNION ALL SELECT chr2, bin_y, counts, NULL FROM contacts WHERE chr1 <> chr2 AND bin_size = 5000) GROUP BY ALL),
sm AS (SELECT chr, bin, avg(value) OVER w AS value, CASE WHEN diagonal > 0 THEN avg(diagonal) OVER w END AS diagonal FROM cs WINDOW w AS (PARTITION BY chr ORDER BY bin RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING))"""


def _column_sums(s, d):
    sums = T.column_sums(contacts(s, d, sizes=(5000,)))
    smooth = T.smoothed_positive(T.smoothed_positive(sums, 3), 3, "diagonal")
    return rounded(T.log_enrichment(T.log_enrichment(smooth), "diagonal"), "value", "diagonal")


BOOK.add("chrom_column_sum", _column_sums, _COLUMNS + " SELECT chr, bin, round(ln(value / (SELECT avg(value) FROM sm WHERE value > 1)), 6) AS value, round(ln(diagonal / (SELECT avg(diagonal) FROM sm WHERE diagonal > 1)), 6) AS diagonal FROM sm")


# Chromosome pairs and the check of a map.
BOOK.add(
    "join_nested_loop_cross",
    lambda s, d: B.chromosome_pairs(fx.chroms(s)).join(contacts(s, d).groupBy("chr1", "chr2").agg(F.count("*").alias("cells")), ["chr1", "chr2"], "left").na.fill(0, ["cells"]),
    "SELECT a.idx AS chr1, b.idx AS chr2, coalesce(n, 0) AS cells FROM chroms a JOIN chroms b ON a.idx <= b.idx LEFT JOIN (SELECT chr1, chr2, count(*) AS n FROM contacts GROUP BY ALL) c ON c.chr1 = a.idx AND c.chr2 = b.idx",
)
BOOK.add(
    "chk_validate",
    lambda s, d: B.validated(contacts(s, d), fx.chroms(s), [2500, 5000, 10000, 20000, 50000], 16),
    """SELECT a.idx AS chr1, b.idx AS chr2, z AS bin_size, coalesce(cells, 0) AS cells, coalesce(bad, 0)::BIGINT AS bad, coalesce(first_block, 0)::BIGINT AS first_block, coalesce(cells, 0) > 0 AND coalesce(bad, 0) = 0 AND coalesce(first_block, 0) > 0 AS good
FROM chroms a JOIN chroms b ON a.idx <= b.idx CROSS JOIN (SELECT CAST(unnest([2500, 5000, 10000, 20000, 50000]) AS BIGINT) AS z) LEFT JOIN (SELECT chr1, chr2, bin_size, count(*) AS cells,
 count_if(counts <= 0 OR (chr1 = chr2 AND bin_x > bin_y) OR bin_x * bin_size >= a.len OR bin_y * bin_size >= b.len) AS bad, count_if(bin_x < 16 AND bin_y < 16) AS first_block
 FROM contacts JOIN chroms a ON a.idx = chr1 JOIN chroms b ON b.idx = chr2 GROUP BY ALL) c ON c.chr1 = a.idx AND c.chr2 = b.idx AND c.bin_size = z""",
)


# Element-wise work.
def _matrix(s, d, control=False):
    return B.mirrored(contacts(s, d, control, (10000,)).where("chr1 = chr2")).select(F.col("chr1").alias("chr"), "i", "j", F.col("counts").alias("value"))


def _elementwise(s, d):
    a, b, keys = _matrix(s, d), _matrix(s, d, True), ["chr"]
    pairs = W.paired(a, b, keys)
    names = W.pair_functions()
    both = pairs.select("chr", "i", "j", F.explode(F.create_map(*(x for n, v in names.items() for x in (F.lit(n), v.cast("double"))))).alias("what", "value"))
    upper = a.where("i <= j")
    sized = a.join(fx.chroms(s).select(F.col("idx").alias("chr"), F.expr("(len - 1) div 10000 + 1").alias("n")), "chr")
    alone = {
        "transposed": W.transposed(upper), "flipped": W.flipped(sized, "n"), "scaled": W.scaled(a, 0.5), "clipped": W.clipped(a, 20.0, 60.0), "marked": W.marked(a, 50.0),
        "steps": W.row_steps(sized, keys, "n"), "stitched": W.stitched(a, W.scaled(a, 2.0)), "cleaned": W.cleaned(a.withColumn("value", F.ln(F.col("value") - 20))),
        "standard": W.standard_scores(a, keys), "rows": W.line_sums(a, keys).withColumn("j", F.lit(-1).cast("long")), "columns": W.line_sums(upper, keys, "j").withColumn("i", F.lit(-1).cast("long")),
        "row_means": W.line_means(sized, keys, F.col("n")).withColumn("j", F.lit(-1).cast("long")),
    }
    out = both.select("what", "chr", "i", "j", "value")
    for what, cells in alone.items():
        out = out.union(cells.select(F.lit(what), "chr", "i", "j", "value"))
    return rounded(out.where("value is not null"), "value")


BOOK.add(
    "mat_elementwise",
    _elementwise,
    """, ma AS (SELECT chr, i, j, counts AS v FROM both_tri WHERE bin_size = 10000), mb AS (SELECT chr1 AS chr, bin_x AS i, bin_y AS j, counts AS v FROM ctrl WHERE chr1 = chr2 AND bin_size = 10000 UNION ALL SELECT chr1, bin_y, bin_x, counts FROM ctrl WHERE chr1 = chr2 AND bin_x <> bin_y AND bin_size = 10000),
pr AS (SELECT chr, i, j, coalesce(ma.v, 0) AS a, coalesce(mb.v, 0) AS b FROM ma FULL JOIN mb USING (chr, i, j)), nn AS (SELECT idx AS chr, (len - 1) // 10000 + 1 AS n FROM chroms), az AS (SELECT ma.*, n FROM ma JOIN nn USING (chr)),
st AS (SELECT chr, i, j - 1 AS j, v FROM az WHERE j > 0 UNION ALL SELECT chr, i, j, -v FROM az WHERE j < n - 1), mo AS (SELECT chr, avg(v) AS m, stddev_pop(v) AS s FROM ma GROUP BY chr),
al AS (SELECT 'total' AS what, chr, i, j, a + b AS value FROM pr UNION ALL SELECT 'difference', chr, i, j, a - b FROM pr UNION ALL SELECT 'product', chr, i, j, a * b FROM pr UNION ALL SELECT 'ratio', chr, i, j, b / a FROM pr
UNION ALL SELECT 'mean', chr, i, j, (a + b) / 2 FROM pr UNION ALL SELECT 'smaller', chr, i, j, least(a, b) FROM pr UNION ALL SELECT 'larger', chr, i, j, greatest(a, b) FROM pr UNION ALL SELECT 'sign', chr, i, j, sign(a - b) FROM pr
UNION ALL SELECT 'difference_size', chr, i, j, abs(a - b) FROM pr UNION ALL SELECT 'transposed', chr, j, i, v FROM ma WHERE i <= j UNION ALL SELECT 'flipped', chr, i, n - 1 - j, v FROM az UNION ALL SELECT 'scaled', chr, i, j, v / 2 FROM ma
UNION ALL SELECT 'clipped', chr, i, j, least(greatest(v, 20), 60) FROM ma UNION ALL SELECT 'marked', chr, i, j, 1 FROM ma WHERE v > 50 UNION ALL SELECT 'steps', chr, i, j, sum(v) FROM st GROUP BY chr, i, j HAVING sum(v) <> 0
UNION ALL SELECT 'stitched', chr, i, j, CASE WHEN i <= j THEN v ELSE 2 * v END FROM ma UNION ALL SELECT 'cleaned', chr, i, j, ln(v - 20) FROM ma WHERE v > 20 UNION ALL SELECT 'standard', chr, i, j, (v - m) / s FROM ma JOIN mo USING (chr)
UNION ALL SELECT 'rows', chr, i, -1, sum(v) FROM ma GROUP BY chr, i UNION ALL SELECT 'columns', chr, -1, j, sum(v) FROM ma WHERE i <= j GROUP BY chr, j UNION ALL SELECT 'row_means', chr, i, -1, sum(v) / max(n) FROM az GROUP BY chr, i)
SELECT what, chr, i, j, round(CAST(value AS DOUBLE), 6) AS value FROM al WHERE value IS NOT NULL""",
)

# Windows around features, resized.
_HALF = 5


def _windows(s, d):
    return A.windows(contacts(s, d, sizes=(2500,)), fx.feat_a(s, d), 2500, _HALF)


_WN = """, md AS (SELECT DISTINCT chr1, chr2, ((start1 + end1) // 2) // 2500 AS m1, ((start2 + end2) // 2) // 2500 AS m2 FROM feat_a),
wn AS (SELECT c.chr1, c.chr2, m1, m2, bin_x - m1 + 5 AS i, bin_y - m2 + 5 AS j, counts FROM contacts c JOIN md ON c.chr1 = md.chr1 AND c.chr2 = md.chr2 AND bin_size = 2500 AND abs(bin_x - m1) <= 5 AND abs(bin_y - m2) <= 5)"""
BOOK.add("apa_enhancement", lambda s, d: rounded(A.enhancements(_windows(s, d), _HALF), "enhancement"), _WN + """, su AS (SELECT chr1, chr2, m1, m2, sum(CASE WHEN i = 5 AND j = 5 THEN counts ELSE 0 END) AS c, sum(counts) AS t FROM wn GROUP BY ALL)
SELECT chr1, chr2, m1, m2, round(CASE WHEN t = c THEN CASE WHEN c = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE c / ((t - c) / 120) END, 6) AS enhancement FROM su""")
BOOK.add(
    "apa_resample",
    lambda s, d: rounded(A.resized(_windows(s, d), 2 * _HALF + 1, 4), "counts"),
    _WN + """, wt AS (SELECT k, r, CASE WHEN k = 10 AND r > k * 4 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - abs(r - k * 4) / 4.0::DOUBLE END AS w FROM range(0, 11) a(k), range(0, 44) b(r) WHERE abs(r - k * 4) < 4),
big AS (SELECT chr1, chr2, m1, m2, x.r AS i, y.r AS j, sum(counts * x.w * y.w) AS v FROM wn JOIN wt x ON x.k = wn.i JOIN wt y ON y.k = wn.j GROUP BY ALL)
SELECT chr1, chr2, m1, m2, i // 11 AS i, j // 11 AS j, round(greatest(0, max(v)), 6) AS counts FROM big GROUP BY chr1, chr2, m1, m2, i // 11, j // 11""",
)


# Tracks with headers: a fixed-step file of coverage a chromosome, and a variable-step file of events.
def _wig_lines(s, d):
    sums = T.coverage(N.row_sums(contacts(s, d, sizes=(2500,))), fx.chroms(s), 2500)
    name = F.concat(F.lit("f"), "chr").alias("file")
    heads = fx.chroms(s).select(F.concat(F.lit("f"), "idx"), F.lit(0).cast("long"), F.concat(F.lit("fixedStep chrom=chr"), "idx", F.lit(" start=1 step=2500 span=2500")))
    events = fx.loci_a(s, d).select(F.concat(F.lit("v"), "chr"), F.col("x1") + 1, F.concat_ws(" ", F.col("x1") + 1, F.col("score").cast("string")))
    tops = fx.chroms(s).select(F.concat(F.lit("v"), "idx"), F.lit(0).cast("long"), F.concat(F.lit("variableStep chrom=chr"), "idx", F.lit(" span=50")))
    return sums.select(name, (F.col("bin") + 1).alias("line"), F.col("value").cast("string").alias("value")).union(heads).union(events).union(tops)


BOOK.add(
    "src_wig",
    lambda s, d: rounded(T1.parse_wig_files(_wig_lines(s, d)), "value"),
    """SELECT 'chr' || idx AS chr, b * 2500 AS start, b * 2500 + 2500 AS "end", round(coalesce(value, 0), 6) AS value FROM chroms JOIN range(0, 200) g(b) ON b <= (len - 1) // 2500 LEFT JOIN rowsums r ON r.bin_size = 2500 AND r.chr = idx AND r.bin = b
UNION ALL SELECT 'chr' || chr, x1, x1 + 50, round(score, 6) FROM loci_a""",
)


def _scaled_to_target(s, d):
    """Row sums of the map scaled to the control's coverage, next to that coverage; both as shares of their chromosome."""
    c = held(s, d, sizes=(10000,))
    target = stored(N.row_sums(contacts(s, d, True, (10000,))))
    vector = balancing.scale(c, target)
    sums = N.row_sums(N.normalize(c, vector))
    both = sums.join(target.withColumnRenamed("value", "wanted"), ["bin_size", "chr", "bin"])
    total = both.groupBy("chr").agg(F.sum("value").alias("t"), F.sum("wanted").alias("w"))
    return both.join(total, "chr").select("chr", "bin", F.round(F.col("value") / F.col("t"), 4).alias("share"), F.round(F.col("wanted") / F.col("w"), 4).alias("wanted"))


BOOK.add("norm_scale_target", _scaled_to_target)
