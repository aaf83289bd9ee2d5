"""Matrix views: scalar functions of a cell's observed and control counts and their expectations.

`two_maps` gives rows with o, e, e0, a (observed, its expectation, the expectation at distance 0, the matrix'
average) and c, ec, ec0, ac for the control map; a view is a column over these. Cells whose view is NaN or
infinite are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectra.functions.ieee import finite, ieee_div
from plectra.operators import expected as E
from plectra.operators.binning import average_counts

KEYS = ["chr1", "chr2", "bin_size", "bin_x", "bin_y"]


def one_map(contacts: DataFrame, chroms: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Cells with o, e, e0 and a, the expectation being the raw one by distance.

    With `of`, the cells are some of the map `of`, whose expectation and averages they get.
    """
    values = E.raw_expected(contacts if of is None else of, chroms)
    averages = average_counts(contacts if of is None else of, chroms)
    zero = values.where("dist = 0").select("bin_size", F.col("value").alias("at_zero"))
    cells = E.with_expected(contacts, values, averages).join(F.broadcast(zero), "bin_size", "left")
    e0 = F.when(F.col("chr1") == F.col("chr2"), F.col("at_zero")).otherwise(F.col("expected"))
    return cells.select(*KEYS, F.col("counts").alias("o"), F.col("expected").alias("e"), e0.alias("e0"), F.col("average_count").alias("a"))


def expected_window(chroms: DataFrame, expected: DataFrame, averages: DataFrame, bin_size: int, chr1: int, x1: int, x2: int, chr2: int, y1: int, y2: int) -> DataFrame:
    """(KEYS, value): the expectation of every cell of a window, whether a count is stored there or not.

    Bins begin in the closed ranges and before their chromosomes' ends. A row of the window is a task's unit of work at least.
    """
    def bins(idx: int, low: int, high: int, name: str) -> DataFrame:
        span = f"sequence({-(-low // bin_size)}L, least({high // bin_size}L, (len - 1) div {bin_size}))"
        return chroms.where(F.col("idx") == idx).where(f"{-(-low // bin_size)} <= least({high // bin_size}L, (len - 1) div {bin_size})").select(F.explode(F.expr(span)).alias(name))

    rows = bins(chr1, x1, x2, "bin_x").repartition("bin_x").withColumns({"chr1": F.lit(chr1).cast("long"), "chr2": F.lit(chr2).cast("long"), "bin_size": F.lit(bin_size).cast("long")})
    # One chromosome's bins at most stand on the other side; each row of the window is put out with all of its columns.
    columns = bins(chr2, y1, y2, "bin_y").agg(F.min("bin_y").alias("a"), F.max("bin_y").alias("b")).where("a is not null")
    cells = rows.crossJoin(F.broadcast(columns)).withColumn("bin_y", F.explode(F.sequence("a", "b"))).drop("a", "b")
    return E.with_expected(cells, expected, averages).select(*KEYS, F.col("expected").alias("value"))


def two_maps(contacts: DataFrame, control: DataFrame, chroms: DataFrame) -> DataFrame:
    """Cells that both maps have."""
    other = one_map(control, chroms).select(*KEYS, F.col("o").alias("c"), F.col("e").alias("ec"), F.col("e0").alias("ec0"), F.col("a").alias("ac"))
    return one_map(contacts, chroms).join(other, KEYS)


def _ln1(x: str | Column) -> Column:
    return F.ln((F.col(x) if isinstance(x, str) else x) + 1)


def _over(a: str, b: str, p: float) -> Column:
    return ieee_div(F.col(a) + p, F.col(b) + p)


def one_map_views() -> dict[str, Column]:
    return {
        "q_observed": F.col("o"),
        "q_expected": F.col("e"),
        "q_oe": _over("o", "e", 0),
        "q_oe_p1": _over("o", "e", 1),
        "q_log": _ln1("o"),
        "q_logeo": ieee_div(_ln1("o"), _ln1("e")),
        "q_explogeo": F.exp(ieee_div(_ln1("o"), _ln1("e"))),
    }


def two_map_views() -> dict[str, Column]:
    mean = (F.col("a") + F.col("ac")) / 2
    oa, ca = ieee_div("o", "a"), ieee_div("c", "ac")
    logeo, logceo = ieee_div(_ln1("o"), _ln1("e")), ieee_div(_ln1("c"), _ln1("ec"))
    out = {
        "q_control": F.col("c"),
        "q_logratio": ieee_div(_ln1(oa), _ln1(ca)),
        "q_logeoratio": ieee_div(logeo, logceo),
        "q_diff": (oa - ca) * mean,
        "q_logceo": logceo,
        "q_explogceo": F.exp(logceo),
        "q_vs_upper": oa * mean,
        "q_vs_lower": ca * mean,
        "q_logvs_upper": _ln1(oa * mean),
        "q_logvs_lower": _ln1(ca * mean),
        "q_ocmevs_upper": F.col("o") - F.col("e"),
        "q_ocmevs_lower": F.col("c") - F.col("ec"),
        "q_logeovs_upper": logeo,
        "q_logeovs_lower": logceo,
    }
    for p, tail in ((0, ""), (1, "_p1")):
        out |= {
            f"q_ratio{tail}": ieee_div(_over("o", "a", p), _over("c", "ac", p)),
            f"q_ratio0{tail}": ieee_div(_over("o", "e0", p), _over("c", "ec0", p)),
            f"q_oeratio{tail}": ieee_div(_over("o", "e", p), _over("c", "ec", p)),
            f"q_oeratio_minus{tail}": _over("o", "e", p) - _over("c", "ec", p),
            f"q_oevs{tail}_upper": _over("o", "e", p),
            f"q_oevs{tail}_lower": _over("c", "ec", p),
        }
    return out


def view(cells: DataFrame, value: Column) -> DataFrame:
    """(keys, value) of one view, finite cells only."""
    return cells.select(*KEYS, value.cast("double").alias("value")).where(finite("value"))


def versus(cells: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """Both triangles of one picture: the first map above the diagonal (i <= j), the second below it (i > j)."""
    top = view(cells.where("chr1 = chr2"), upper).select("chr1", "bin_size", F.col("bin_x").alias("i"), F.col("bin_y").alias("j"), "value")
    under = view(cells.where("chr1 = chr2 and bin_x <> bin_y"), lower).select("chr1", "bin_size", F.col("bin_y").alias("i"), F.col("bin_x").alias("j"), "value")
    return top.unionByName(under).withColumnRenamed("chr1", "chr")


def inverse_norm(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 / (v[i] * v[j] * max(1, |i - j|)^4) on every cell inside a chromosome."""
    from plectra.operators.norm import normalize

    ones = contacts.where("chr1 = chr2").withColumn("counts", F.lit(1.0))
    distance = F.greatest(F.lit(1), F.abs(F.col("bin_x") - F.col("bin_y"))).cast("double")
    return normalize(ones, vectors).select(*KEYS, ieee_div("counts", F.pow(distance, F.lit(4.0))).alias("value"))
