"""Statistics of read pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.operators.lift import site_distance
from plectra.operators.pairs import NO_MAPQ, orientation

#: Histogram bins of a distance: BINS bins, PER_DECADE a power of ten.
BINS, PER_DECADE = 100, 12.5
#: Deviation of the four orientations from their mean logarithm that counts as converged, and bins it must last.
CONVERGED, LASTING = 0.01, 3


def _least_mapq():
    return F.least(F.coalesce("mapq1", F.lit(NO_MAPQ)), F.coalesce("mapq2", F.lit(NO_MAPQ)))


def pair_statistics(pairs: DataFrame, thresholds: tuple[int, ...] = (1, 30)) -> DataFrame:
    """One row per quality threshold of conditional counts, from one pass; needs frag1 and frag2."""
    levels = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    rows = pairs.select("*", levels).withColumns(
        {
            "same__": (F.col("chr1") == F.col("chr2")) & (F.col("frag1") == F.col("frag2")),
            "good__": _least_mapq() >= F.col("threshold"),
            "d__": F.abs(F.col("pos1") - F.col("pos2")),
            "o__": orientation(),
        }
    )
    contact = ~F.col("same__") & F.col("good__")
    intra = contact & (F.col("chr1") == F.col("chr2"))
    far = intra & (F.col("d__") >= 20_000)
    counts = {
        "n_intra_fragment": F.col("same__"),
        "n_below_mapq": ~F.col("same__") & ~F.col("good__"),
        "n_contacts": contact,
        "n_inter": contact & (F.col("chr1") != F.col("chr2")),
        "n_intra": intra,
        "n_under_500": intra & (F.col("d__") < 500),
        "n_500_5k": intra & (F.col("d__") >= 500) & (F.col("d__") < 5000),
        "n_5k_20k": intra & (F.col("d__") >= 5000) & (F.col("d__") < 20_000),
        "n_over_20k": far,
    } | {f"n_{o}": far & (F.col("o__") == o) for o in ("left", "inner", "outer", "right")}
    return rows.groupBy("threshold").agg(F.count("*").alias("n_unique"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def ligations(pairs: DataFrame, junction: str, dangling: str) -> DataFrame:
    """Counts of pairs with the ligation junction in a read, and of dangling ends (a read that starts with the site)."""
    has = F.coalesce(F.contains("seq1", F.lit(junction)), F.lit(False)) | F.coalesce(F.contains("seq2", F.lit(junction)), F.lit(False))
    starts = F.coalesce(F.startswith("seq1", F.lit(dangling)), F.lit(False)) | F.coalesce(F.startswith("seq2", F.lit(dangling)), F.lit(False))
    return pairs.agg(F.count_if(has).alias("n_ligation"), F.count_if(starts).alias("n_dangling"))


def distance_histogram(pairs: DataFrame) -> DataFrame:
    """(orientation, bin, n) over log-spaced distances of pairs inside a chromosome."""
    d = F.abs(F.col("pos1") - F.col("pos2"))
    place = F.when(d < 1, 0).otherwise(F.least(F.lit(BINS - 1), F.floor(F.log10(d) * PER_DECADE + 1e-9))).cast("long")
    return pairs.where("chr1 = chr2").groupBy(orientation().alias("orientation"), place.alias("bin")).agg(F.count("*").alias("n"))


def mapq_histogram(pairs: DataFrame, most: int = 200) -> DataFrame:
    return pairs.groupBy(_least_mapq().alias("mapq")).agg(F.count("*").alias("n")).where(F.col("mapq") <= most)


def site_histogram(pairs: DataFrame, sites: DataFrame, most: int = 2000) -> DataFrame:
    """(site_distance, n) of first ends."""
    rows = site_distance(pairs, sites, "chr1", "pos1")
    return rows.where(F.col("site_distance") <= most).groupBy("site_distance").agg(F.count("*").alias("n"))


def lior_convergence(pairs: DataFrame) -> DataFrame:
    """(bin): the first distance bin from which the four orientations agree for a few bins; null if none does."""
    spark = pairs.sparkSession
    rows = distance_histogram(pairs).collect()  # four orientations by BINS bins
    table = [[0] * 4 for _ in range(BINS)]
    for r in rows:
        table[r.bin][("left", "inner", "outer", "right").index(r.orientation)] = r.n

    def error(counts: list[int]) -> float:
        if min(counts) == 0:
            return 1e3
        logs = [math.log(c) for c in counts]
        mean = sum(logs) / 4
        return max(abs(x - mean) / mean if mean else abs(x - mean) for x in logs)

    errors = [error(c) for c in table]
    found = next((i for i in range(BINS) if all(e < CONVERGED for e in errors[i : i + LASTING + 1])), None)
    return spark.createDataFrame([(found,)], "bin long")


def duplicate_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(n_total, n_unique, n_duplicates) of pairs that agree in all keys."""
    groups = pairs.groupBy(*keys).agg(F.count("*").alias("c"))
    return groups.agg(F.sum("c").alias("n_total"), F.count("*").alias("n_unique"), F.sum(F.col("c") - 1).alias("n_duplicates"))


def library_size(unique: int, duplicates: int) -> int | None:
    """Distinct molecules X of a library with c/X = 1 - exp(-n/X), c unique among n reads.

    With u = n/X this is the root over 0 of the concave 1 - exp(-u) - u c/n. Newton steps from u = n/c, where it
    is negative, fall to the root without passing it.
    """
    n = unique + duplicates
    if unique <= 0 or duplicates <= 0:
        return None
    share = unique / n
    u = 1 / share
    while True:
        move = (-math.expm1(-u) - share * u) / (math.exp(-u) - share)
        if move <= 1e-15 * u:
            return int(n / u)
        u -= move


def library_size_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(n_unique, n_duplicates, library_size) of pairs that may repeat."""
    row = duplicate_counts(pairs, keys).first()
    size = library_size(row.n_unique, row.n_duplicates or 0)
    return pairs.sparkSession.createDataFrame([(row.n_unique, row.n_duplicates, size)], "n_unique long, n_duplicates long, library_size long")


#: How lines of a statistics file name what they count, in the order in which they are looked for, any letter case.
LINES = [
    ("n_no_chimera", "No chimera found:"),
    ("n_three_or_more", "3 or more alignments"),
    ("n_ligation", "Ligation Motif Present:"),
    ("n_unique", "Total Unique:"),
    ("n_duplicates", "Total Duplicates:"),
    ("n_intra_fragment", "Intra-fragment Reads:"),
    ("n_below_mapq", "Below MAPQ Threshold:"),
    ("n_contacts", "Hi-C Contacts:"),
    ("three_bias", "3' Bias (Long Range):"),
    ("pair_percents", "Pair Type %(L-I-O-R):"),
    ("convergence", "L-I-O-R Convergence:"),
    ("n_inter", "Inter-chromosomal:"),
    ("n_intra", "Intra-chromosomal:"),
    ("n_under_500", "<500BP:"),
    ("n_500_5k", "500BP-5kB:"),
    ("n_5k_20k", "5kB-20kB:"),
    ("n_over_20k", "Long Range (>20Kb):"),
]
#: What pair_percents is where all four orientations have 25 % in every file, and where they have not.
EVEN, UNEVEN = 25, -1


def statistics_lines(stats: DataFrame) -> DataFrame:
    """(*other columns, value): a file's lines of each row of `pair_statistics`, numbers with commas and their share of the pairs."""
    texts = dict(LINES)
    shares = [F.concat(F.round(F.col(f"n_{o}") * 100 / F.greatest(F.col("n_over_20k"), F.lit(1))).cast("int").cast("string"), F.lit("%")) for o in ("left", "inner", "outer", "right")]
    lines = [F.concat(F.lit(f"{texts['pair_percents']} "), F.concat_ws(" - ", *shares))]
    for name in (c for c, _ in LINES if c in stats.columns):
        share = F.format_string("%.2f", F.col(name) * 100 / F.greatest(F.col("n_unique"), F.lit(1)))
        lines.append(F.concat(F.lit(f"{texts[name]} "), F.format_number(F.col(name), 0), F.lit(" ("), share, F.lit("%)")))
    counts = [c for c in stats.columns if not c.startswith("n_")]
    return stats.select(*counts, F.explode(F.array(*lines)).alias("value"))


def merge_statistics(lines: DataFrame) -> DataFrame:
    """(statistic, value) of the lines of any number of statistics files (value string): sums, but the largest convergence; pair_percents as above.

    Lines count whose text is known, with one colon and a number behind it (to a bracket; commas do not matter); those with N/A do not.
    """
    low = F.lower("value")
    named = F.coalesce(*(F.when(F.contains(low, F.lit(text.lower())), F.lit(name)) for name, text in LINES))
    halves = F.split("value", ":")
    behind = F.element_at(halves, 2)
    known = lines.where(F.contains("value", F.lit(":"))).select(named.alias("statistic"), F.when(F.size(halves) == 2, behind).alias("text")).where("statistic is not null and text is not null and not contains(lower(text), 'n/a')")
    number = F.expr("try_cast(trim(replace(split(text, '[(]')[0], ',', '')) as bigint)")
    even = F.when(F.size(F.split("text", "25%")) == 5, EVEN).otherwise(UNEVEN)
    values = known.withColumn("n", F.when(F.col("statistic") == "pair_percents", even).otherwise(number)).where("n is not null")
    merged = values.groupBy("statistic").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    chosen = F.when(F.col("statistic") == "convergence", F.col("most")).when(F.col("statistic") == "pair_percents", F.col("least")).otherwise(F.col("total"))
    return merged.select("statistic", chosen.cast("long").alias("value"))
