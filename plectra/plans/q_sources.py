"""Queries of readers and writers: text and records that Spark derives from the tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import expected as E
from plectra.operators import norm as N
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded
from plectra.plans.q_maps import contacts, shelved
from plectra.plans.storage import scratch_dir, stored
from plectra.sources import features_text as T
from plectra.sources import file_forms as FF
from plectra.sources import map_file as MF
from plectra.sources import matrix_files as MX
from plectra.sources import pairs_binary as R
from plectra.sources import pairs_text as P
from plectra.sources import phased as PH
from plectra.sources import raw_files as RF
from plectra.sources import store as ST

BOOK = Book()


def _pairs(s, d):
    return fx.pairs(s, d).withColumns({"frag1": F.expr("pos1 div 1000"), "frag2": F.expr("pos2 div 1000"), "seq1": F.lit("ACGT"), "seq2": F.lit("GATC")})


def _sql(n):
    has = P.LAYOUTS[n]

    def value(f):
        if f.startswith("chr"):
            return f"CAST({f} AS VARCHAR) AS {f}"
        if f.startswith("frag"):
            return (f"{f.replace('frag', 'pos')} // 1000" if f in has else f"CAST({0 if f[-1] == '1' else 1} AS BIGINT)") + f" AS {f}"
        if f.startswith("mapq"):
            return (f if f in has else "CAST(1000 AS BIGINT)") + f" AS {f}"
        if f.startswith("strand"):
            return (f if f in has else "true") + f" AS {f}"
        if f.startswith("seq"):
            return (f"'{'ACGT' if f[-1] == '1' else 'GATC'}'" if f in has else "CAST(NULL AS VARCHAR)") + f" AS {f}"
        if f == "score":
            return ("CAST(score AS DOUBLE)" if f in has else "CAST(1 AS DOUBLE)") + " AS score"
        return f

    return "SELECT " + ", ".join(map(value, P.SCHEMA)) + " FROM pairs"


for _name, _n in (("src_pairs_super_short", 4), ("src_pairs_super_short_score", 5), ("src_pairs_short", 8), ("src_pairs_short_score", 9), ("src_pairs_medium", 11), ("src_pairs_long", 16)):
    BOOK.add(_name, lambda s, d, n=_n: P.parse_lines(P.to_lines(_pairs(s, d), n), n), _sql(_n))
_DCIC = "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq1 mapq2"


def _written(s, rows, placed=False):
    """The folder that the rows' files are in."""
    path = scratch_dir(s)
    RF.write_files(rows, path, placed=placed)
    return path


def _lines_written(s, rows):
    """The lines of the files, read back."""
    return s.read.option("recursiveFileLookup", "true").text(_written(s, rows))


def _pairs_written(s, d, kind):
    rows = RF.read_records(s, _written(s, FF.binary_pairs(_pairs(s, d), kind)), kind)
    return rows.withColumns({f"strand{i}": F.col(f"strand{i}") == 0 for i in (1, 2)})


def _dcic(s, d):
    """A folder of pair files, one a partition, and one that holds the header."""
    rows = fx.pairs(s, d)
    fields = ["chr1", "pos1", "chr2", "pos2", F.expr("if(strand1, '+', '-')"), F.expr("if(strand2, '+', '-')"), "mapq1", "mapq2"]
    body = rows.select(F.concat(F.lit("p"), F.spark_partition_id().cast("string"), F.lit(".pairs")).alias("path"), F.lit(1).alias("seq"), F.concat(F.concat_ws(" ", F.lit("r"), *fields), F.lit("\n")).alias("content"))
    head = s.range(1).select(F.lit("head.pairs").alias("path"), F.lit(0).alias("seq"), F.lit("## pairs format v1.0\n" + _DCIC + "\n").alias("content"))
    return P.read_pairs(s, _written(s, body.unionByName(head), placed=True)).select("chr1", "pos1", "chr2", "pos2", "strand1", "strand2", "mapq1", "mapq2")


BOOK.add("src_pairs_dcic", _dcic, "SELECT CAST(chr1 AS VARCHAR) AS chr1, pos1, CAST(chr2 AS VARCHAR) AS chr2, pos2, strand1, strand2, mapq1, mapq2 FROM pairs")
BOOK.add("src_pairs_bin", lambda s, d: _pairs_written(s, d, R.LONG), "SELECT strand1, strand2, chr1, pos1, pos1 // 1000 AS frag1, chr2, pos2, pos2 // 1000 AS frag2 FROM pairs")
BOOK.add("src_pairs_bn", lambda s, d: _pairs_written(s, d, R.SHORT), "SELECT strand1, strand2, chr1, pos1, chr2, pos2 FROM pairs")
BOOK.add("sink_pairs_bin", lambda s, d: R.packed(_pairs(s, d)).select(F.sum(F.length("content")).alias("bytes")), "SELECT CAST(count(*) * 26 AS BIGINT) AS bytes FROM pairs")


def _lines(df, *columns, sep="\t"):
    return df.select(F.concat_ws(sep, *columns).alias("value"))


BOOK.add("src_triples", lambda s, d: T.parse_triples(_lines(contacts(s, d, sizes=(5000,)), "bin_x", "bin_y", F.col("counts").cast("string"))), "SELECT bin_x, bin_y, counts FROM contacts WHERE bin_size = 5000")
BOOK.add("src_chrom_sizes", lambda s, d: T.parse_sizes(_lines(fx.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("n"), (F.col("s_suppkey") * 1000).alias("l")), "n", "l")), "SELECT 's' || s_suppkey AS name, CAST(s_suppkey AS BIGINT) * 1000 AS len FROM supplier")
BOOK.add("src_sites", lambda s, d: T.parse_sites(_lines(fx.loci_b(s, d).select(F.concat(F.lit("c"), "x1").alias("c"), "x1", "x2"), "c", "x1", "x2", sep=" ")), "SELECT 'c' || x1 AS chr, CAST(0 AS BIGINT) AS site_idx, x1 AS pos FROM loci_b UNION ALL SELECT 'c' || x1, 1, x2 FROM loci_b")
BOOK.add("src_bed", lambda s, d: T.parse_bed(_lines(fx.loci_a(s, d), F.concat(F.lit("chr"), "chr"), "x1", "x2", "name")), "SELECT DISTINCT 'chr' || chr AS chr, x1, x2 FROM loci_a")
_HEAD = ["c1", "s1", "e1", "c2", "s2", "e2", "name", "score", "st1", "st2", "color", "key"]
BOOK.add(
    "src_bedpe",
    lambda s, d: T.parse_bedpe(_lines(fx.feat_a(s, d), "chr1", "start1", "end1", "chr2", "start2", "end2", F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("0,0,255"), "p_partkey"), _HEAD).select("chr1", "start1", "end1", "chr2", "start2", "end2", "color", F.col("attributes")["key"].alias("key")),
    "SELECT CAST(chr1 AS VARCHAR) AS chr1, start1, end1, CAST(chr2 AS VARCHAR) AS chr2, start2, end2, '0,0,255' AS color, CAST(p_partkey AS VARCHAR) AS key FROM feat_a",
)
BOOK.add(
    "src_loops_legacy",
    lambda s, d: T.parse_loops(_lines(fx.feat_a(s, d), "chr1", "start1", "end1", "chr2", "start2", "end2", F.lit("red"), "p_size"), ["chr1", "x1", "x2", "chr2", "y1", "y2", "color", "size"]).select("chr1", "start1", "end1", "chr2", "start2", "end2", "color", F.col("attributes")["size"].alias("size")),
    "SELECT CAST(chr1 AS VARCHAR) AS chr1, start1, end1, CAST(chr2 AS VARCHAR) AS chr2, start2, end2, 'red' AS color, CAST(p_size AS VARCHAR) AS size FROM feat_a",
)
BOOK.add("src_domains", lambda s, d: T.parse_domains(_lines(fx.loci_b(s, d), "chr", "x1", "x2")), "SELECT CAST(chr AS VARCHAR) AS chr1, x1 AS start1, x2 AS end1, CAST(chr AS VARCHAR) AS chr2, x1 AS start2, x2 AS end2 FROM loci_b")
BOOK.add(
    "src_fimo",
    lambda s, d: T.parse_motifs(_lines(fx.loci_a(s, d), F.lit("m"), F.concat(F.lit("c"), F.col("chr").cast("string"), F.lit(":100-900")), "x1", "x2", F.lit("+"), F.lit("1.5"), F.lit("0.25"), F.lit("0.5"), "name")),
    "SELECT 'c' || chr AS chr, x1 + 100 AS x1, x2 + 100 AS x2, true AS strand, CAST(1.5 AS DOUBLE) AS score, CAST(0.25 AS DOUBLE) AS p, CAST(0.5 AS DOUBLE) AS q, name AS sequence FROM loci_a",
)
BOOK.add("src_genes", lambda s, d: T.parse_genes(_lines(fx.loci_a(s, d), "name", "chr", "x1", "x2")), "SELECT name, CAST(chr AS VARCHAR) AS chr, x1 + 1 AS x1, x2 - 1 AS x2 FROM loci_a")
BOOK.add("src_assembly", lambda s, d: T.parse_scaffolds(_lines(fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), F.concat(F.lit(">s"), "id"), "id", F.lit("500"), sep=" ")), "SELECT 's' || s_suppkey AS name, CAST(s_suppkey AS BIGINT) AS id, CAST(500 AS BIGINT) AS length, (row_number() OVER (ORDER BY s_suppkey) - 1) * 500 + 1 AS orig_start FROM supplier")
BOOK.add("src_vector_file", lambda s, d: rounded(T.parse_wig(fx.loci_b(s, d).select(F.expr("x1 div 10").alias("line"), F.col("x2").cast("string").alias("value")), "v", 0, 1), "value"), "SELECT 'v' AS chr, x1 // 10 AS start, x1 // 10 + 1 AS \"end\", CAST(x2 AS DOUBLE) AS value FROM loci_b")
BOOK.add("sink_text_triples", lambda s, d: _lines_written(s, FF.triples(contacts(s, d))), "SELECT (bin_x * bin_size)::VARCHAR || chr(9) || (bin_y * bin_size)::VARCHAR || chr(9) || CAST(counts AS BIGINT)::VARCHAR AS value FROM contacts")


def _attributed(s, d):
    """Features with the attributes of every layout, made of their columns."""
    keys = sorted({k for x in FF.LAYOUTS.values() for k in x} - {"radius"})
    made = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.concat(F.lit(k + "="), F.col("p_partkey").cast("string")) for k in keys)))
    return fx.feat_b(s, d).withColumns({"attributes": made, "color": F.lit("0,0,255")})


def _layout_sql(keys):
    fixed = "concat_ws(chr(9), chr1, start1, end1, chr2, start2, end2, '.', '.', '.', '.', '0,0,255'"
    values = "".join(f", '{k}=' || p_partkey" if k != "radius" else ", 'null'" for k in keys)
    head = "\t".join([*FF.FEATURE, *keys])
    return f"SELECT {fixed}{values}) AS value FROM feat_b UNION ALL SELECT DISTINCT '{head}' AS value FROM feat_b"


def _with_heads(s, rows, keys):
    """The lines read back; of the header lines, which every file has, one."""
    lines = _lines_written(s, rows)
    return lines.where("value not like '#%'").unionByName(lines.where("value like '#%'").distinct())


for _layout, _keys in FF.LAYOUTS.items():
    BOOK.add("sink_bedpe" if _layout == "final" else f"sink_bedpe_{_layout}", lambda s, d, n=_layout, k=tuple(_keys): _with_heads(s, FF.features(_attributed(s, d), n), k), _layout_sql(_keys))
BOOK.add("sink_bed", lambda s, d: _lines_written(s, FF.bed(fx.loci_a(s, d))), "SELECT concat_ws(chr(9), chr, x1, x2, name) AS value FROM loci_a")


def _assembly_files(s, d):
    rows = fx.table(s, d, "supplier").selectExpr("concat('s', s_suppkey) AS name", "cast(s_suppkey as bigint) + 1 AS id", "500 AS length", "cast(s_suppkey div 3 as bigint) AS grp", "s_suppkey AS ord", "if(s_suppkey % 3 = 0, -1, 1) * (s_suppkey + 1) AS signed_id")
    return _lines_written(s, FF.assembly(rows, rows))


BOOK.add("sink_assembly", _assembly_files, """SELECT '>s' || s_suppkey || ' ' || (s_suppkey + 1) || ' 500' AS value FROM supplier
UNION ALL SELECT string_agg(CAST(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (s_suppkey + 1) AS VARCHAR), ' ' ORDER BY s_suppkey) FROM supplier GROUP BY s_suppkey // 3""")
BOOK.add("sink_wig", lambda s, d: _lines_written(s, FF.fixed_step(N.row_sums(contacts(s, d, sizes=(2500, 10000))).where("bin % 7 <> 3").withColumn("value", F.col("value").cast("long")))), """, t AS (SELECT *, bin - lag(bin) OVER (PARTITION BY bin_size, chr ORDER BY bin) AS gap FROM rowsums WHERE bin_size IN (2500, 10000) AND bin % 7 <> 3)
SELECT CAST(value AS BIGINT)::VARCHAR AS value FROM t UNION ALL SELECT 'fixedStep chrom=' || chr || ' start=' || (bin * bin_size + 1) || ' step=' || bin_size || ' span=' || bin_size FROM t WHERE gap IS NULL OR gap > 1""")
BOOK.add("sink_text_dense", lambda s, d: _lines_written(s, FF.dense_rows(contacts(s, d, sizes=(5000, 10000)), fx.chroms(s), 8)), """, nb AS (SELECT idx AS chr, CAST(b AS BIGINT) AS bin_size, (len - 1) // b + 1 AS n FROM chroms, (SELECT unnest([5000, 10000]) AS b))
SELECT value FROM (SELECT nb.chr, nb.bin_size, x.i, string_agg(CAST(coalesce(counts, 0)::BIGINT AS VARCHAR), chr(9) ORDER BY y.j) AS value FROM nb JOIN range(0, 200) x(i) ON x.i < n JOIN range(0, 200) y(j) ON y.j < n
LEFT JOIN both_tri t ON t.chr = nb.chr AND t.bin_size = nb.bin_size AND t.i = x.i AND t.j = y.j GROUP BY ALL)""")
BOOK.add("sink_binary", lambda s, d: RF.read_records(s, _written(s, FF.binary_cells(contacts(s, d, sizes=(5000,)), 10)), MX.CELL, 1200), "SELECT bin_x, bin_y, counts FROM contacts WHERE bin_size = 5000")


# Dense matrices of every chromosome, in blocks of rows.
def _sized(s, d):
    own = contacts(s, d, sizes=(10000,)).where("chr1 = chr2").join(fx.chroms(s).select(F.col("idx").alias("chr1"), F.expr("(len - 1) div 10000 + 1").alias("n")), "chr1")
    return own.select(F.col("chr1").alias("chr"), "n", F.col("bin_x").alias("i"), F.col("bin_y").alias("j"), F.col("counts").alias("value"))


def _npy(s, d):
    files = s.read.format("binaryFile").option("recursiveFileLookup", "true").load(_written(s, FF.npy_blocks(MX.numpy_blocks(_sized(s, d), 4))))
    part = lambda k: F.element_at(F.split(F.regexp_replace("path", r"\.npy$", ""), "/"), k).cast("long")
    return MX.from_numpy_blocks(files.select(part(-2).alias("chr"), part(-1).alias("block"), "content"), 4)


def _matrix_txt(s, d):
    rows = MX.matrix_lines(_sized(s, d)).withColumn("value", F.concat_ws(" ", "chr", "i", "value"))
    lines = _lines_written(s, FF.lines_of(rows, F.concat(F.col("chr").cast("string"), F.lit(".txt")), "i"))
    cut = F.split("value", " ", 3)
    return MX.parse_matrix_lines(lines.select(cut[0].cast("long").alias("chr"), cut[1].cast("long").alias("i"), cut[2].alias("value")))


_UPPER = "SELECT chr1 AS chr, bin_x AS i, bin_y AS j, counts AS value FROM contacts WHERE chr1 = chr2 AND bin_size = 10000"
BOOK.add("sink_npy", _npy, _UPPER)
BOOK.add("sink_matrix_txt", _matrix_txt, _UPPER)
BOOK.add("flt_chrom_lookup", lambda s, d: fx.table(s, d, "customer").select("c_custkey", T.clean_chromosome(F.concat(F.lit("chr"), F.col("c_mktsegment"))).alias("name")), "SELECT c_custkey, lower(c_mktsegment) AS name FROM customer")
BOOK.add("flt_resolution_pick", lambda s, d: fx.loci_b(s, d).select((F.col("x2") - F.col("x1")).alias("wanted")).distinct().select("wanted", F.array_min(F.transform(F.array(*(F.lit(x) for x in (500, 1000, 2500))), lambda r: F.struct(F.abs(r - F.col("wanted")).alias("d"), r.alias("r")))).getField("r").cast("long").alias("resolution")), "SELECT DISTINCT w AS wanted, CAST(CASE WHEN abs(w - 500) <= abs(w - 1000) AND abs(w - 500) <= abs(w - 2500) THEN 500 WHEN abs(w - 1000) <= abs(w - 2500) THEN 1000 ELSE 2500 END AS BIGINT) AS resolution FROM (SELECT x2 - x1 AS w FROM loci_b)")
BOOK.add("set_zoom_chrom_intersection", lambda s, d: contacts(s, d).select("bin_size", "chr1").distinct().intersect(contacts(s, d, True).where("chr1 <> 2").select("bin_size", "chr1")), "SELECT DISTINCT bin_size, chr1 FROM contacts INTERSECT SELECT DISTINCT bin_size, chr1 FROM ctrl WHERE chr1 <> 2")
BOOK.add("sink_parquet_map", lambda s, d: ST.read_store(s, shelved(s, d)), "SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts")


# Map files, written and read again; vectors are stored as four-byte numbers in the newest version, eight-byte ones before.
def _map_file(s, d, version=9, sizes=fx.SIZES):
    path = scratch_dir(s)
    cells = stored(contacts(s, d, sizes=sizes))
    MF.write_map(cells, fx.chroms(s), path, version, block_bins=20)
    return path, cells


_CELLS = ("chr1", "chr2", "bin_size", "bin_x", "bin_y", "counts")
BOOK.add("src_hic", lambda s, d: MF.read_map(s, _map_file(s, d)[0]).select(*_CELLS), "SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts")
BOOK.add("sink_hic", lambda s, d: MF.read_map(s, _map_file(s, d, 8)[0], "matrices").groupBy("chr1", "chr2", "bin_size").agg(F.sum("total").alias("total")), "SELECT chr1, chr2, bin_size, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) AS total FROM contacts GROUP BY ALL")
BOOK.add(
    "src_hic_matrix",
    lambda s, d: MF.region_of_map(s, _map_file(s, d, sizes=(2500,))[0], 2500, 1, 20000, 90000, 1, 60000, 150000).select(*_CELLS),
    """SELECT chr1, chr2, bin_size, bin_x, bin_y, counts FROM contacts WHERE chr1 = 1 AND chr2 = 1 AND bin_size = 2500
 AND (bin_x * 2500 BETWEEN 20000 AND 90000 AND bin_y * 2500 BETWEEN 60000 AND 150000 OR bin_x * 2500 BETWEEN 60000 AND 150000 AND bin_y * 2500 BETWEEN 20000 AND 90000)""",
)


def _vector_of_file(s, d):
    path, cells = _map_file(s, d, 8)
    MF.append_vectors(N.vanilla_coverage(cells), fx.chroms(s), path, "VC", 8)
    part = MF.read_map(s, path, "vectors", norm="VC", chr=1, bin_size=5000, bin=(5, 25)).where(~F.isnan("value"))
    return rounded(part.select("bin_size", "chr", "bin", "value"), "value")


def _expected_of_file(s, d):
    path, cells = _map_file(s, d, 8)
    MF.append_vectors(E.raw_expected(cells, fx.chroms(s)), fx.chroms(s), path, "NONE", 8)
    return rounded(MF.read_map(s, path, "expected", norm="NONE", dist=(3, 9)).select("bin_size", "dist", "value"), "value")


BOOK.add("src_norm_vector", _vector_of_file, "SELECT bin_size, chr, bin, round(value, 6) AS value FROM vc WHERE chr = 1 AND bin_size = 5000 AND bin BETWEEN 5 AND 25")
BOOK.add("src_expected_part", _expected_of_file, "SELECT bin_size, dist, round(value, 6) AS value FROM ex WHERE dist BETWEEN 3 AND 9")


def _stored_vectors(s, d):
    """Vectors and expectations appended to the store of a map, and normalised cells from what it holds."""
    path = shelved(s, d, sizes=(10000,))
    cells = ST.read_store(s, path)
    for norm, root in (("VC", False), ("VC_SQRT", True)):
        ST.append_vectors(N.vanilla_coverage(cells, root), path, norm)
    return rounded(N.normalize(cells, ST.read_vectors(s, path, "VC")), "counts")


BOOK.add("sink_norm_footer", _stored_vectors, """, nv AS (SELECT c.*, counts / (v1.value * v2.value) AS nvalue FROM contacts c JOIN vc v1 ON v1.bin_size = c.bin_size AND v1.chr = c.chr1 AND v1.bin = bin_x JOIN vc v2 ON v2.bin_size = c.bin_size AND v2.chr = c.chr2 AND v2.bin = bin_y)
SELECT chr1, chr2, bin_size, bin_x, bin_y, round(nvalue, 6) AS counts FROM nv WHERE bin_size = 10000""")


# Phased scaffolds: a variant each supplier, rows of three.
def _psf(s, d):
    own = fx.table(s, d, "supplier").withColumn("id", F.col("s_suppkey") + 1)
    head = own.select(F.struct(F.lit(0).alias("k"), F.col("id").alias("at")).alias("seq"), F.concat(F.lit(">"), F.concat_ws(" ", F.concat(F.lit("n"), "s_nationkey"), F.col("id") * 10, F.lit("A"), F.lit("C"), "id"), F.lit("\n")).alias("content"))
    rows = own.groupBy(F.expr("s_suppkey div 3").alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.expr("if(s_suppkey % 3 = 0, -id, id) AS v")))), lambda x: x.getField("v").cast("string")), " ").alias("line"))
    lines = head.unionByName(rows.select(F.struct(F.lit(1).alias("k"), F.col("g").cast("long").alias("at")).alias("seq"), F.concat("line", F.lit("\n")).alias("content")))
    return PH.read_psf(s, _written(s, lines.withColumn("path", F.lit("in.psf"))))


_PSF = """, v AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_suppkey AS BIGINT) + 1 AS id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS BIGINT) AS sg, s_nationkey AS nk FROM supplier)"""
BOOK.add("src_psf", lambda s, d: PH.psf_order(_psf(s, d)), _PSF + """ SELECT 2 * (k // 3) + o + 1 AS grp, 2 * 3 * (k // 3) + o * count(*) OVER (PARTITION BY k // 3, o) + k % 3 + 1 AS ord,
 CASE WHEN (sg > 0) = (o = 0) THEN 2 * id - 1 ELSE 2 * id END AS signed_id, CAST(1000 AS BIGINT) AS length FROM v, range(0, 2) r(o)""")
BOOK.add("sink_psf", lambda s, d: _lines_written(s, PH.psf_lines(PH.psf_scaffolds(_psf(s, d)), PH.psf_order(_psf(s, d)))), _PSF + """ SELECT '>n' || nk || ' ' || id * 10 || ' A C ' || id AS value FROM v UNION ALL SELECT string_agg(CAST(sg * id AS VARCHAR), ' ' ORDER BY id) FROM v GROUP BY k // 3""")
