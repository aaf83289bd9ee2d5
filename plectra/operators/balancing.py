"""Iterative balancing of symmetric matrices: Newton steps with conjugate gradients, and alternating scaling.

All matrices (bin_size, chr) of a map go through their rounds together. A round is one product of the cells with a
vector, a join and a grouped sum with partial sums; vectors stay tables of rows, cut off by stored tables. What the
driver holds is a handful of numbers a matrix: sums over rows, from which it chooses each matrix' next step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plectra.functions.ieee import ieee_div
from plectra.operators.binning import mirrored
from plectra.plans.storage import discard, stored

#: Shares of rows in per cent, by their sums, that are left out when Newton steps fail: after each attempt.
LEFT_OUT = (1, 2, 3, 4, 10)
#: Scaled values under this mark rows that cannot be balanced.
TINY = 0.01
#: Alternating scaling: share of rows with the fewest cells that are left out, its growth on a stall and its bounds; rounds of one
#: run and of all; an error that shrinks by less than this share does not shrink.
SPARSEST, GROWTH, MOST, RUN, ROUNDS, SHRINKS = 1e-4, 5e-5, 0.2, 100, 300, 0.02


class Matrices:
    """The matrices of a map by number: `links` holds every cell from both of its rows, `rows` the sum and cells of each row."""

    def __init__(self, contacts: DataFrame):
        own = contacts.where("chr1 = chr2 and counts > 0")
        self.keys = sorted((r.bin_size, r.chr1) for r in own.select("bin_size", "chr1").distinct().collect())  # a row a matrix
        named = contacts.sparkSession.createDataFrame([(m, b, c) for m, (b, c) in enumerate(self.keys)], "m int, bin_size long, chr1 long")
        both = mirrored(own).join(F.broadcast(named), ["bin_size", "chr1"])
        self.names = named.withColumnRenamed("chr1", "chr")
        self.links = stored(both.select("m", F.col("i").alias("bin"), F.col("j").alias("at"), "counts"))
        self.rows = stored(self.links.groupBy("m", "bin").agg(F.sum("counts").alias("total"), F.count("*").alias("cells")))

    def times(self, vector: DataFrame) -> DataFrame:
        """(m, bin, q): each matrix times its vector (m, bin, t); rows that the vector lacks count as 0."""
        other = vector.select("m", F.col("bin").alias("at"), "t")
        return self.links.join(other, ["m", "at"]).groupBy("m", "bin").agg(F.sum(F.col("counts") * F.col("t")).alias("q"))

    def with_product(self, state: DataFrame, by: str) -> DataFrame:
        """The state with q = matrix times its column `by`."""
        product = self.times(state.select("m", "bin", F.col(by).alias("t")))
        return state.join(product, ["m", "bin"], "left").na.fill(0.0, ["q"])

    def given(self, table: DataFrame, values: dict[int, dict[str, float]]) -> DataFrame:
        """The rows of the matrices in `values`, with these as columns: constants by the matrix' number, not a join."""
        number = lambda x: "null" if x is None else f"double('{x}')" if x != x or abs(x) == math.inf else f"{float(x)!r}D"
        names = list(next(iter(values.values())))
        of = {n: ", ".join(number(values.get(m, {}).get(n)) for m in range(len(self.keys))) for n in names}
        held = " or ".join(f"m = {m}" for m in values) if len(values) < 9 else f"m in ({', '.join(map(str, values))})"
        return table.where(held).withColumns({n: F.expr(f"element_at(array({x}), m + 1)") for n, x in of.items()})

    def sums(self, table: DataFrame, **of: F.Column) -> dict[int, dict[str, float]]:
        found = table.groupBy("m").agg(*(c.alias(n) for n, c in of.items())).collect()  # a row a matrix
        return {r.m: {n: r[n] for n in of} for r in found}

    def finished(self, vector: DataFrame) -> DataFrame:
        """(bin_size, chr, bin, value) of all rows with cells, NaN where the vector has none, rescaled to keep the sum of valid cells."""
        inverse = vector.where("b > 0 and not isnan(b)").select("m", "bin", F.col("b").alias("t"))
        ones = self.with_product(inverse.select("m", "bin", F.lit(1.0).alias("t")), "t").groupBy("m").agg(F.sum("q").alias("raw"))
        norm = self.with_product(inverse, "t").groupBy("m").agg(F.sum(F.col("t") * F.col("q")).alias("norm"))
        factor = norm.join(ones, "m").select("m", F.sqrt(ieee_div("norm", "raw")).alias("factor"))
        out = self.rows.select("m", "bin").join(inverse, ["m", "bin"], "left").join(F.broadcast(factor), "m", "left")
        value = F.coalesce(ieee_div(F.col("factor"), F.col("t")), F.lit(float("nan")))
        return out.join(F.broadcast(self.names), "m").select("bin_size", "chr", "bin", value.alias("value"))


def chosen(mode: F.Column, *values: F.Column) -> F.Column:
    """The value whose number `mode` is."""
    out = F.when(mode == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(mode == k, v)
    return out


def knight_ruiz(contacts: DataFrame, tolerance: float = 1e-6, delta: float = 0.1, stalls: int = 100) -> DataFrame:
    """(bin_size, chr, bin, value) by Newton steps, each solved by conjugate gradients.

    A matrix whose steps stall, `stalls` times together, starts again without its rows of the smallest sums: 1 to 4 per cent
    after the first attempts, 10 per cent after the fifth, which never counts. Rows whose scaled value is tiny are left out
    and the rest starts again. After six attempts a matrix is NaN; so are rows left out, always.
    """
    a = Matrices(contacts)
    if not a.keys:
        return a.rows.join(F.broadcast(a.names), "m").select("bin_size", "chr", "bin", F.lit(float("nan")).alias("value"))
    use = stored(a.rows.where("total > 0").select("m", "bin"))
    active = set(range(len(a.keys)))
    done: list[DataFrame] = []
    for attempt in range(1, 7):
        x, failed = _newton(a, use, tolerance, delta, stalls)
        again = active if attempt == 5 else failed
        good = active - again
        parts = []
        if good:
            b = a.given(x, {m: {"keep": 1.0} for m in good}).select("m", "bin", F.col("x").alias("b"))
            # 1 / x is the vector; its factor comes from the sums of the balanced and the raw cells.
            raw = a.sums(a.with_product(b.withColumn("t", F.lit(1.0)), "t"), raw=F.sum("q"))
            norm = a.sums(a.with_product(b, "b"), norm=F.sum(F.col("b") * F.col("q")))
            factors = {m: {"factor": math.sqrt(norm[m]["norm"] / raw[m]["raw"]) if raw[m]["raw"] else math.nan} for m in good}
            tiny = ieee_div(F.col("factor"), F.col("b")) < TINY
            rated = stored(a.given(b, factors).withColumn("tiny", tiny & ~F.isnan("b")))
            tossed = {m for m, s in a.sums(rated, tossed=F.count_if("tiny")).items() if s["tossed"]}
            if good - tossed:
                done.append(a.given(rated, {m: {"keep": 1.0} for m in good - tossed}).select("m", "bin", "b"))
            if tossed:
                parts.append(a.given(rated.where("not tiny"), {m: {"keep": 1.0} for m in tossed}).select("m", "bin"))
            active = again | tossed
        if not active or attempt == 6:
            break
        if again:
            parts.append(_largest(a, again, LEFT_OUT[attempt - 1]))
        use = parts[0]
        for more in parts[1:]:
            use = use.union(more)
        use = stored(use)
    vector = done[0] if done else a.rows.select("m", "bin", F.lit(float("nan")).alias("b"))
    for more in done[1:]:
        vector = vector.union(more)
    return a.finished(stored(vector))


def _largest(a: Matrices, of: set[int], percent: float) -> DataFrame:
    """Rows with sums over a percentile, which lies at place p * (n + 1) of the sorted sums, between neighbours in proportion."""
    ranked = a.given(a.rows.where("total <> 0"), {m: {"keep": 1.0} for m in of})
    sizes = a.sums(ranked, n=F.count("*"))
    places = {}
    for m, s in sizes.items():
        at = min(max(percent / 100 * (s["n"] + 1), 1.0), float(s["n"]))
        places[m] = {"low": math.floor(at), "high": math.ceil(at), "part": at - math.floor(at)}
    # Sums counted by value: a row each distinct sum, so the order needs no row numbers.
    by_value = ranked.groupBy("m", "total").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("m").orderBy("total"))
    spans = a.given(by_value.withColumn("upto", upto), places)
    value = lambda at: F.min(F.when(F.col("upto") >= F.col(at), F.col("total")))
    limit = spans.groupBy("m").agg((value("low") + F.max("part") * (value("high") - value("low"))).alias("limit"))
    return ranked.join(F.broadcast(limit), "m").where("total > limit").select("m", "bin")


def _newton(a: Matrices, use: DataFrame, tolerance: float, delta: float, stalls: int) -> tuple[DataFrame, set[int]]:
    """(m, bin, x) with x * (A x) = 1 over the rows in use, and the matrices that stalled.

    x is the balance so far, v = x * (A x), r its residual; y corrects x and p is its next direction. Each round multiplies x,
    for a residual, or x * p, for a step along p; a step that would bring y under delta goes only so far.
    """
    one = F.lit(1.0)
    state = use.select("m", "bin", one.alias("x"), one.alias("v"), one.alias("r"), one.alias("y"), one.alias("p"), one.alias("t"))
    known: dict[int, dict] = {m: {"inner": False} for m in a.sums(use, n=F.count("*"))}
    done: list[DataFrame] = []
    failed: set[int] = set()
    target = tolerance**2
    held: list[DataFrame] = []
    while known:
        now = stored(a.with_product(a.given(state, {m: {"inner": s["inner"]} for m, s in known.items()}), "t"))
        x, v, r, y, p, q = (F.col(c) for c in ("x", "v", "r", "y", "p", "q"))
        w, residual = x * q + v * p, 1 - x * q
        found = a.sums(now, pw=F.sum(p * w), rr=F.sum(residual * residual), rrv=F.sum(ieee_div(residual * residual, x * q)))
        inner = {m: {"alpha": _over(s["rho"], found[m]["pw"])} for m, s in known.items() if s["inner"]}
        ahead = {}
        if inner:
            alpha = F.col("alpha")
            back = F.when(alpha * p < 0, ieee_div(delta - y, alpha * p))
            left = r - alpha * w
            ahead = a.sums(a.given(now, inner), least=F.min(F.when(~F.isnan(y + alpha * p), y + alpha * p)), gamma=F.min(F.when(~F.isnan(back), back)), rho=F.sum(ieee_div(left * left, v)))
        steps: dict[int, dict[str, float]] = {}
        for m, s in list(known.items()):
            if s["inner"]:
                alpha = inner[m]["alpha"]
                if ahead[m]["least"] is not None and ahead[m]["least"] <= delta:
                    steps[m] = {"mode": 2, "alpha": alpha * (ahead[m]["gamma"] if ahead[m]["gamma"] is not None else math.inf), "beta": 0}
                    s["inner"] = False
                    continue
                before, s["rho"] = s["rho"], ahead[m]["rho"]
                s["inner"] = s["rho"] > s["enough"]
                steps[m] = {"mode": 1 if s["inner"] else 2, "alpha": alpha, "beta": _over(s["rho"], before)}
                continue
            rho = found[m]["rr"]
            if "out" not in s:
                s |= {"out": rho, "old": rho, "eta": 0.1, "same": 0}
            else:
                s["same"] += abs(rho - s["out"]) < 1e-6 or math.isinf(rho)
                s["out"] = rho
                change, s["old"], eta = _over(rho, s["old"]), rho, s["eta"]
                s["eta"] = 0.9 * change
                if 0.9 * eta**2 > 0.1:
                    s["eta"] = max(s["eta"], 0.9 * eta**2)
                s["eta"] = max(min(s["eta"], 0.1), _over(0.5 * tolerance, math.sqrt(rho) if rho == rho else rho))
            if not (s["out"] > target and s["same"] < stalls):
                if s["same"] >= stalls:
                    failed.add(m)
                steps[m] = {"mode": 3, "alpha": 0, "beta": 0}
                del known[m]
                continue
            s |= {"inner": True, "enough": max(s["eta"] ** 2 * s["out"], target), "rho": found[m]["rrv"]}
            steps[m] = {"mode": 0, "alpha": 0, "beta": 0}
        if ended := {m: {"keep": 1.0} for m, s in steps.items() if s["mode"] == 3}:
            done.append(a.given(now, ended).select("m", "bin", "x"))
        else:
            held.append(now)
        if not known:
            break
        # The next state: a first direction, a next one, a new balance.
        mode, alpha, beta = F.col("mode"), F.col("alpha"), F.col("beta")
        moved, v0, r0 = y + alpha * p, x * q, r - alpha * w
        direction = chosen(mode, ieee_div(residual, v0), ieee_div(r0, v) + beta * p, p)
        balance = chosen(mode, x, x, x * moved)
        state = a.given(now, {m: s for m, s in steps.items() if s["mode"] < 3}).select(
            "m", "bin", balance.alias("x"), chosen(mode, v0, v, v).alias("v"), chosen(mode, residual, r0, r).alias("r"),
            chosen(mode, one, moved, one).alias("y"), direction.alias("p"), chosen(mode, x * direction, x * direction, x * moved).alias("t"),
        )
        for old in held[:-1]:
            discard(old)
        del held[:-1]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return stored(out), failed


def _over(a: float, b: float) -> float:
    """Division as Java and numpy have it."""
    if b:
        return a / b
    return math.nan if not a or a != a else math.copysign(math.inf, a)


def scale(contacts: DataFrame, target: DataFrame | None = None, tolerance: float = 5e-4, sparsest: float = SPARSEST, growth: float = GROWTH) -> DataFrame:
    """(bin_size, chr, bin, value) by scaling rows and columns in turns until row sums are those of the target, or one.

    target: (bin_size, chr, bin, value); rows without a value are left out, rows whose target is 0 become 0 and then NaN. Rows
    with the fewest cells are left out, too: a share `sparsest` of them, which grows by `growth` when the scaling stalls; it then starts
    again if the error has grown over five rounds, or goes on. The error of row sums is taken every tenth round.
    """
    a = Matrices(contacts)
    rows = a.rows.withColumn("z", F.lit(1.0))
    if target is not None:
        wanted = target.join(F.broadcast(a.names), ["bin_size", "chr"]).select("m", "bin", F.col("value").cast("double").alias("z"))
        rows = a.rows.join(wanted, ["m", "bin"], "left").na.fill(float("nan"), ["z"])
    rows = stored(rows.where("cells > 0"))
    sizes = {m: s["n"] for m, s in a.sums(rows, n=F.count("*")).items()}
    if not sizes:
        return a.rows.join(F.broadcast(a.names), "m").select("bin_size", "chr", "bin", F.lit(float("nan")).alias("value"))
    counted = rows.groupBy("m", "cells").agg(F.count("*").alias("k"))
    counted = stored(counted.withColumn("upto", F.sum("k").over(Window.partitionBy("m").orderBy("cells"))))

    def least(shares: dict[int, float]) -> dict[int, int]:
        """The number of cells under which rows are left out, for a share of each matrix' rows."""
        places = {m: {"place": int(max(0.0, sizes[m] * s + 0.5))} for m, s in shares.items()}
        return {m: s["least"] for m, s in a.sums(a.given(counted, places).where("upto > place"), least=F.min("cells")).items()}

    shares = dict.fromkeys(sizes, sparsest)
    low = least(shares)
    z, bad = F.col("z"), F.col("bad")
    first = a.given(rows, {m: {"low": v} for m, v in low.items()}).withColumn("bad", (((F.col("cells") < F.col("low")) & (z > 0)) | F.isnan(z)).cast("double"))
    first = first.withColumns({"one": F.when(z == 0, 0.0).otherwise(1.0), "z": F.when(bad == 1, 1.0).otherwise(z)}).drop("low", "total")
    start = a.with_product(first, "one").withColumnRenamed("q", "row0")
    off = F.when((bad == 1) | (z == 0), 1.0).otherwise(0.0)
    state = stored(start.select("m", "bin", "cells", "z", "bad", off.alias("off"), (1 - bad).alias("dr"), (1 - bad).alias("dc"), F.col("row0").alias("row"), "row0", (1 - bad).alias("was")))
    known = {m: {"iter": 0, "all": 0, "errors": [], "sums": [], "err": 10.0 * (1 + tolerance)} for m in sizes}
    done: list[DataFrame] = []
    old: list[DataFrame] = []
    while known:
        keep = {m: {"keep": 1.0} for m in known}
        own = lambda c: F.when(F.col("off") == 1, 1.0).otherwise(c)
        by_row = a.given(state, keep).drop("keep").withColumn("dr", F.col("dr") * ieee_div(z, own(F.col("row"))))
        by_column = stored(a.with_product(by_row, "dr"))
        column = by_column.withColumn("dc", F.col("dc") * ieee_div(z, own(F.col("q") * F.col("dc")))).drop("q")
        now = a.with_product(column, "dc")
        now = stored(now.withColumns({"row": F.col("q") * F.col("dr"), "b": F.sqrt(F.col("dr") * F.col("dc"))}).drop("q"))
        change = F.abs(F.col("b") - F.col("was"))
        changes = a.sums(now, most=F.max(F.when((F.col("off") == 0) & ~F.isnan(change), change)))
        for s in known.values():
            s["iter"] += 1
            s["all"] += 1
        if tenth := {m: {"keep": 1.0} for m, s in known.items() if s["iter"] % 10 == 0}:
            error = F.abs(F.col("q") * F.col("b") - z)
            for m, s in a.sums(a.with_product(a.given(now, tenth).drop("keep"), "b"), err=F.max(F.when((F.col("off") == 0) & ~F.isnan(error), error))).items():
                known[m]["err"] = s["err"] or 0.0
                known[m]["sums"].append(known[m]["err"])
        steps: dict[int, dict[str, float]] = {}
        for m, s in list(known.items()):
            change_ = changes[m]["most"] or 0.0
            s["errors"].append(change_)
            steps[m] = {"mode": _after(s, change_, tolerance)}
            if steps[m]["mode"]:
                shares[m] += growth
                s |= {"iter": 0, "sums": [], "err": 10.0 * (1 + tolerance)}
                change_ = 10.0 * (1 + tolerance)
            if not ((change_ > tolerance or s["err"] > 5 * tolerance) and s["iter"] < RUN and s["all"] < ROUNDS and shares[m] <= MOST):
                done.append(now.where(F.col("m") == m).select("m", "bin", F.when(bad == 1, float("nan")).otherwise(F.col("b")).alias("b")))
                del known[m], steps[m]
        lows = least({m: shares[m] for m, s in steps.items() if s["mode"]}) if any(s["mode"] for s in steps.values()) else {}
        if not known:
            break
        for m, s in steps.items():
            s["low"] = lows.get(m, 0)
        mode, more = F.col("mode"), (F.col("cells") < F.col("low")) & (z > 0)
        stepped = a.given(now, steps).withColumns({"bad": F.when(more, 1.0).otherwise(bad), "off": F.when(more, 1.0).otherwise(F.col("off")), "z": F.when(more, 1.0).otherwise(z)})
        good = 1 - bad
        state = stepped.withColumns(
            {
                "dr": chosen(mode, F.col("dr"), F.col("dr") * good, good), "dc": chosen(mode, F.col("dc"), F.col("dc") * good, good),
                "row": chosen(mode, F.col("row"), F.col("row"), F.col("row0")), "was": chosen(mode, F.col("b"), F.col("b"), good),
            }
        ).drop("b", "mode", "low")
        old.append(by_column)
        discard(*old[:-1])
        del old[:-1]
    vector = done[0]
    for part in done[1:]:
        vector = vector.union(part)
    return a.finished(stored(vector))


def _after(s: dict, change: float, tolerance: float) -> int:
    """0: on; 1: a stall, more rows go and the scaling goes on; 2: a stall, and it starts again."""
    sums, errors = s["sums"], s["errors"]
    if change < tolerance and (len(sums) < 2 or sums[-1] < 0.5 * sums[-2]):
        return 0
    if s["iter"] <= 5:
        return 0
    stalled = not any(errors[-k] * (1 + SHRINKS) < errors[-k - 1] for k in range(1, 6))
    if len(sums) >= 2 and sums[-1] > 0.75 * sums[-2]:
        stalled = True
    if not stalled and s["iter"] < RUN:
        return 0
    return 2 if errors[-1] > errors[-6] else 1


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"KR": knight_ruiz, "SCALE": scale}


def balanced(contacts: DataFrame, chroms: DataFrame, norm: str) -> DataFrame:
    """(bin_size, chr, bin, value) of a norm by its name: VC, VC_SQRT, KR or SCALE of each chromosome; GW_ before VC, KR and
    SCALE for the genome as one matrix, INTER_ for the same without cells inside a chromosome.
    """
    from plectra.operators import norm as N

    scope, _, method = norm.rpartition("_") if norm.startswith(("GW_", "INTER_")) else ("", "", norm)
    of = {"VC": N.vanilla_coverage, "VC_SQRT": lambda c: N.vanilla_coverage(c, root=True)} | METHODS
    if method not in of or scope and method == "VC_SQRT":
        raise ValueError(f"norm {norm} is not known")
    if not scope:
        return of[method](contacts)
    return N.split_vector(of[method](stored(N.offset_contacts(contacts, chroms, between_only=scope == "INTER"))), chroms)
