"""Queries of scaffold edits, element-wise matrices, loop comparison, and text forms of matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from plectra.operators import assembly as S
from plectra.operators import binning as B
from plectra.operators import features2d as X
from plectra.operators import loop_merge as LM
from plectra.operators import models as M
from plectra.operators import norm as N
from plectra.plans import fixtures as fx
from plectra.plans.book import Book, rounded
from plectra.plans.q_maps import contacts, held
from plectra.plans.q_models import _kernel
from plectra.plans.storage import stored

BOOK = Book()


def _order(s, d):
    """A scaffold order from the suppliers, groups of three."""
    return fx.table(s, d, "supplier").selectExpr(
        "cast(s_suppkey div 3 as bigint) + 1 AS grp", "cast(s_suppkey as bigint) + 1 AS ord",
        "cast(if(s_suppkey % 3 = 0, -1, 1) * (s_suppkey + 1) as bigint) AS signed_id", "cast(1000 + s_nationkey * 10 as bigint) AS length",
    )


_ORD = """, od AS (SELECT CAST(s_suppkey // 3 AS BIGINT) + 1 AS grp, CAST(s_suppkey AS BIGINT) + 1 AS ord, CAST(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (s_suppkey + 1) AS BIGINT) AS signed_id, CAST(1000 + s_nationkey * 10 AS BIGINT) AS length FROM supplier)"""


def _o(name, f, sql):
    BOOK.add(name, lambda s, d: f(_order(s, d)), None if sql is None else _ORD + "\n" + sql)


_o("asm_invert", lambda o: S.invert(o, 3, 6), "SELECT grp, CASE WHEN ord BETWEEN 3 AND 6 THEN 9 - ord ELSE ord END AS ord, CASE WHEN ord BETWEEN 3 AND 6 THEN -signed_id ELSE signed_id END AS signed_id, length FROM od")
_o("asm_move", lambda o: S.move(o, 2, 3, 7), "SELECT CASE WHEN ord IN (2, 3) THEN (SELECT grp FROM od WHERE ord = 7) ELSE grp END AS grp, CASE WHEN ord IN (2, 3) THEN ord + 4 WHEN ord BETWEEN 4 AND 7 THEN ord - 2 ELSE ord END AS ord, signed_id, length FROM od")
_o("asm_merge", lambda o: S.merge(o, 1, 2), "SELECT CASE WHEN grp IN (1, 2) THEN 1 ELSE grp END::BIGINT AS grp, ord, signed_id, length FROM od")
_o("asm_split", lambda o: S.split(o, 4), "SELECT grp + CASE WHEN grp > g OR (grp = g AND ord > 4) THEN 1 ELSE 0 END AS grp, ord, signed_id, length FROM od, (SELECT grp AS g FROM od WHERE ord = 4)")
_o("asm_cut", lambda o: S.cut(o, 5, 300, 500), """SELECT CASE WHEN k = 1 THEN (SELECT max(grp) + 1 FROM od) ELSE grp END AS grp, row_number() OVER (ORDER BY k = 1, ord, CASE WHEN signed_id < 0 THEN -k ELSE k END) AS ord,
 CASE WHEN abs(signed_id) = 5 THEN (5 + k) * sign(signed_id) WHEN abs(signed_id) > 5 THEN sign(signed_id) * (abs(signed_id) + 2) ELSE signed_id END::BIGINT AS signed_id,
 CASE WHEN abs(signed_id) <> 5 THEN length WHEN k = 0 THEN 300 WHEN k = 1 THEN 200 ELSE length - 500 END::BIGINT AS length FROM od, range(0, 3) r(k) WHERE k = 0 OR abs(signed_id) = 5""")
_o("asm_toggle", lambda o: S.toggle(o, 4, 6), """SELECT 1 + sum(CASE WHEN was IS NOT NULL AND (grp <> was OR ord BETWEEN 4 AND 7) THEN 1 ELSE 0 END) OVER (ORDER BY ord)::BIGINT AS grp, ord, signed_id, length
FROM (SELECT *, lag(grp) OVER (ORDER BY ord) AS was FROM od)""")
_PARTNER = "CASE WHEN abs(signed_id) % 2 = 0 THEN abs(signed_id) - 1 ELSE abs(signed_id) + 1 END"
_o("asm_phase_merge", lambda o: S.phase_merge(o, 1, 2), f""", al AS (SELECT min(grp) AS alt FROM od WHERE abs(signed_id) IN (SELECT {_PARTNER} FROM od WHERE grp = 1)),
ng AS (SELECT CASE WHEN grp = 2 THEN 1 WHEN alt IS NOT NULL AND abs(signed_id) IN (SELECT {_PARTNER} FROM od WHERE grp = 2) THEN alt ELSE grp END::BIGINT AS grp, ord, signed_id, length FROM od, al)
SELECT grp, row_number() OVER (ORDER BY grp, ord) AS ord, signed_id, length FROM ng""")


def _undone(o):
    h = S.History(o)
    h.push(S.invert(o, 1, 5))
    h.push(S.merge(h.states[1], 1, 3))
    h.undo()
    h.undo()
    return h.redo()


_o("asm_undo_redo", _undone, "SELECT grp, CASE WHEN ord BETWEEN 1 AND 5 THEN 6 - ord ELSE ord END AS ord, CASE WHEN ord BETWEEN 1 AND 5 THEN -signed_id ELSE signed_id END AS signed_id, length FROM od")


BOOK.add("agg_block_merge", lambda s, d: B.sum_maps([contacts(s, d).where("counts >= 0"), contacts(s, d, True)]).groupBy("chr1", "chr2", "bin_size", B.block_number(8, 10).alias("block_number")).agg(F.sum("counts").alias("counts"), F.count("*").alias("cells")), """, sm AS (SELECT chr1, chr2, bin_size, bin_x, bin_y, sum(counts) AS counts FROM (SELECT * FROM contacts UNION ALL SELECT * FROM ctrl) GROUP BY ALL)
SELECT chr1, chr2, bin_size, CASE WHEN chr1 = chr2 THEN CAST(floor(log2(1 + abs(bin_x - bin_y) / sqrt(2.0) / 8)) AS BIGINT) * 10 + ((bin_x + bin_y) // 2) // 8 ELSE (bin_y // 8) * 10 + bin_x // 8 END AS block_number, sum(counts) AS counts, count(*) AS cells FROM sm GROUP BY ALL""")

def _differential(s, d):
    """Loops of the map that the control has none near, and that are not enriched there."""
    cells = {control: held(s, d, control, (2500,)) for control in (False, True)}
    kernels = {control: stored(_kernel(s, c)) for control, c in cells.items()}
    loops = {control: M.loop_filter(k, 1.1, 1.2, 1.3) for control, k in kernels.items()}
    return M.loop_difference(loops[False], loops[True], kernels[True], cells[True], 1).select("chr", "i", "j", "observed")


BOOK.add("loop_diff", _differential)
BOOK.add("loop_scores", lambda s, d: rounded(_kernel(s, contacts(s, d, sizes=(2500,))).join(fx.feat_a(s, d).select(F.col("chr1").alias("chr"), F.expr("start1 div 2500").alias("i"), F.expr("start2 div 2500").alias("j")).distinct(), ["chr", "i", "j"], "left_semi"), "bl", "donut", "h", "v"))


#: Loops of several bin sizes, spread over ten million bases: parts dealt over the sizes, coarse ones moved a little.
def _loops_of(s, d, sizes):
    at = fx.feat_a(s, d).withColumns({"k": F.col("p_partkey") % len(sizes), "start1": (F.col("p_partkey") * 7919 % 2000) * 5000})
    at = at.withColumn("start2", F.col("start1") + (2 + F.col("p_partkey") * 13 % 60) * 5000)
    out = {}
    for k, size in enumerate(sizes):
        own = at.where(F.col("k") == k).withColumns({c: F.col(c) + F.col("p_size") % 8 * size for c in ("start1", "start2")})
        own = own.withColumns({"end1": F.col("start1") + size, "end2": F.col("start2") + size, "observed": (F.col("p_partkey") % 130).cast("double")})
        out[size] = own.select(*X.COORDS, "observed")
    return out


def _loops_sql(sizes):
    parts = [f"""SELECT 1 + p_partkey % 3 AS chr1, st AS start1, st + {z} AS end1, 1 + p_partkey % 3 AS chr2, en AS start2, en + {z} AS end2, CAST(p_partkey % 130 AS DOUBLE) AS observed, CAST({z} AS BIGINT) AS bin_size
 FROM (SELECT *, (p_partkey * 7919 % 2000) * 5000 + p_size % 8 * {z} AS st, (p_partkey * 7919 % 2000) * 5000 + (2 + p_partkey * 13 % 60) * 5000 + p_size % 8 * {z} AS en FROM part) WHERE p_partkey % {len(sizes)} = {k}""" for k, z in enumerate(sizes)]
    lists = ", ".join(f"l{z} AS (SELECT * FROM lp WHERE bin_size = {z} QUALIFY row_number() OVER (PARTITION BY chr1, start1, end1, chr2, start2, end2 ORDER BY observed) = 1)" for z in sizes)
    return f"WITH lp AS ({' UNION ALL '.join(parts)}), {lists}"


def _near_sql(a, other, radius):
    return f"EXISTS (SELECT 1 FROM {other} o WHERE o.chr1 = {a}.chr1 AND o.chr2 = {a}.chr2 AND sqrt(pow(o.start1 - {a}.start1, 2) + pow(o.start2 - {a}.start2, 2)) <= {radius})"


_FIRST, _SECOND = (5000, 10000, 25000), (1000, 2000, 5000, 10000)
_PLACED = "SELECT DISTINCT chr1, start1, end1, chr2, start2, end2, bin_size FROM "
BOOK.add("loop_merge_res", lambda s, d: LM.merge_resolutions(_loops_of(s, d, _FIRST)).select(*X.COORDS, "bin_size"), f"""{_loops_sql(_FIRST)},
m AS (SELECT * FROM l5000 WHERE {_near_sql('l5000', 'l10000', 20000)} OR abs(start1 - start2) < 110000 OR observed > 100 UNION ALL SELECT * FROM l10000 WHERE NOT {_near_sql('l10000', 'l5000', 20000)})
{_PLACED} (SELECT * FROM m UNION ALL SELECT * FROM l25000 WHERE NOT {_near_sql('l25000', 'm', 50000)})""", prelude=False)
BOOK.add("loop_merge_res_fine", lambda s, d: LM.merge_resolutions(_loops_of(s, d, _SECOND), second=True).select(*X.COORDS, "bin_size"), f"""{_loops_sql(_SECOND)},
alone AS (SELECT * FROM l2000 WHERE NOT {_near_sql('l2000', 'l1000', 4000)}),
m AS (SELECT * FROM l1000 WHERE {_near_sql('l1000', 'l2000', 4000)} OR {_near_sql('l1000', 'l5000', 10000)} OR abs(start1 - start2) < 50000 OR observed > 20
 UNION ALL SELECT * FROM alone WHERE {_near_sql('alone', 'l5000', 10000)} OR abs(start1 - start2) < 80000 OR observed > 40
 UNION ALL SELECT * FROM l5000 WHERE NOT {_near_sql('l5000', 'l1000', 10000)} AND NOT {_near_sql('l5000', 'l2000', 10000)})
{_PLACED} (SELECT * FROM m UNION ALL SELECT * FROM l10000 WHERE NOT {_near_sql('l10000', 'm', 20000)})""", prelude=False)
