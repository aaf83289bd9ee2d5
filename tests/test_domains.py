"""Domains: kernels against sums written out, windows and merges against plain versions, planted domains found."""

import math

import numpy as np
import pytest

from plectra.kernels import dense
from plectra.operators import domains as O

CELLS = "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double"


def _cells(spark, m, size=10, chrom=1):
    return spark.createDataFrame([(chrom, chrom, size, int(i), int(j), float(m[i, j])) for i, j in np.argwhere(np.triu(m))], CELLS)


def _planted(n, edges, rng, level=20.0, ground=0.4):
    """Counts that are high inside the domains [edge, next edge) and low elsewhere."""
    m = rng.poisson(ground, (n, n)).astype(float)
    for a, b in zip(edges, edges[1:], strict=False):
        m[a:b, a:b] = rng.poisson(level, (b - a, b - a))
    return np.triu(m) + np.triu(m, 1).T


def test_directionality_by_row():
    m = np.random.default_rng(1).poisson(3, (30, 30)).astype(float)
    m = np.triu(m) + np.triu(m, 1).T
    found, gap, n = dense.directionality(m, 4), 4, 30
    for i in range(n):
        most = min(n - (i + gap), i - gap)
        for d in range(n - i):
            a, b = (m[i, i - d], m[i, i + d]) if gap <= d <= most else (0.0, 0.0)
            assert math.isclose(found[i, i + d], (a - b) / (a + b) if a + b else 0.0)


@pytest.mark.parametrize("n", [1, 2, 9, 24])
def test_blocks_by_their_cells(n):
    d = np.triu(np.random.default_rng(n).normal(size=(n, n)))
    got = dense.blocks(d)
    names = ("up", "lo")
    want = {k: np.zeros((n, n)) for k in ("up", "lo", "up_sign", "lo_sign", "up_var", "lo_var")}
    for a in range(n):
        for b in range(a + 1, n):
            parts = [d[a + t, c] for t in range(b - a) for c in range(a + 2 * t + 1, b + 1)], [d[r, c] for r in range(a + 1, b + 1) for c in range(b + 1, min(2 * r - a, n - 1) + 1)]
            for name, part in zip(names, parts, strict=True):
                x = np.array(part or [0.0])
                want[name][a, b], want[f"{name}_sign"][a, b], want[f"{name}_var"][a, b] = x.mean(), np.sign(x).mean(), x.var()

    def scaled(x):
        return x / x.max() if x.max() > 0 else x * 0

    score = scaled(want["lo"] - want["up"]) + scaled(want["lo_sign"] - want["up_sign"]) - scaled(want["up_var"] + want["lo_var"])
    assert np.allclose(got.score, score) and np.allclose(got.up_sign, -want["up_sign"]) and np.allclose(got.lo_sign, want["lo_sign"])
    assert np.allclose(got.up_var, want["up_var"]) and np.allclose(got.lo_var, want["lo_var"])


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 0.7, 1.0])
def test_components_by_flooding(share):
    mask = np.random.default_rng(3).random((25, 31)) < share
    got, seen = dense.components8(mask), np.zeros(mask.shape, int)
    for i, j in np.argwhere(mask):
        if not seen[i, j]:
            todo, k = [(i, j)], seen.max() + 1
            while todo:
                x, y = todo.pop()
                if 0 <= x < 25 and 0 <= y < 31 and mask[x, y] and not seen[x, y]:
                    seen[x, y] = k
                    todo += [(x + u, y + v) for u in (-1, 0, 1) for v in (-1, 0, 1)]
    assert (got == seen).all()


def test_planted_domains_at_the_default_limits(spark):
    n, edges = 600, [120, 210, 300, 390]
    chroms = spark.createDataFrame([(1, n * 10), (2, 900)], "idx long, len long")
    m = _planted(n, edges, np.random.default_rng(5), ground=5.0)
    cells = _cells(spark, m).union(_cells(spark, np.triu(np.random.default_rng(6).poisson(5, (90, 90))), chrom=2))
    got = O.domains(cells, chroms, width=400).collect()
    sure = [r for r in got if r.chr == 1 and r.up_sign >= 0.5 and r.lo_sign >= 0.5 and r.up_var + r.lo_var <= 0.2]
    for a, b in zip(edges, edges[1:], strict=False):
        assert any(abs(r.start // 10 - a) <= 5 and abs(r.end // 10 - b) <= 5 for r in sure), (a, b, sure)
    assert len(sure) == 3
    assert not [r for r in got if r.chr == 2 and r.up_sign >= 0.5 and r.lo_sign >= 0.5]


def test_windows_stop_at_the_first_sign_of_the_chromosome(spark):
    n, width, gap = 130, 40, 2
    m = _planted(n, [10, 34, 60, 100], np.random.default_rng(8), 3.0, 1.0)
    chroms = spark.createDataFrame([(1, n * 10 - 3)], "idx long, len long")
    got = {(r.start, r.sign, r.variance, r.i, r.j) for r in O.found_blocks(_cells(spark, m), chroms, width, gap).collect()}
    starts = sorted({s for s in range(0, n, width // 2) if s + width < n} | {n - width})
    by_window = {}
    for s in starts:
        part = np.zeros((width + 1, width + 1))
        inside = m[s : s + width + 1, s : s + width + 1]
        part[: len(inside), : len(inside)] = inside
        by_window[s] = dense.blocks(dense.directionality(part, gap))
    want = {(s, 0.5, 0.2, int(i) + s, int(j) + s) for s, b in by_window.items() for i, j in zip(*dense.corners(b, 0.5, 0.2), strict=True)}
    for sign in (0.4, 0.3, 0.2, 0.1, 0.0):
        others = {(s, sign, None, int(i) + s, int(j) + s) for s, b in by_window.items() for i, j in zip(*dense.corners(b, sign), strict=True)}
        if others:
            break
    assert others and got == want | others


def test_merges_of_whole_chromosomes(spark):
    """Islands give what one pass over all blocks of a chromosome gives."""
    n, width, gap = 300, 60, 2
    edges = [5, 30, 42, 70, 71, 110, 150, 152, 190, 230, 262, 290]
    m = _planted(n, edges, np.random.default_rng(9), 6.0, 0.5)
    chroms = spark.createDataFrame([(1, n * 10), (2, 500)], "idx long, len long")
    cells = _cells(spark, m)
    found = sorted(O.found_blocks(cells, chroms, width, gap).collect(), key=lambda r: (r.start, r.i, r.j))
    sure = [(r.i, r.j, *(r[v] for v in O.VALUES)) for r in found if r.variance is not None]
    others = {(r.i, r.j, *(r[v] for v in O.VALUES)) for r in found if r.variance is None and r.j - r.i > 8}
    taken, edges_ = list(sure), {e for b in sure for e in b[:2]}
    for b in sorted(others - set(sure)):
        if not any(k in edges_ for k in range(b[0], b[1] + 1)):
            taken.append(b)
            edges_ |= set(b[:2])
    for reach in (5, 10):
        bins = []
        for b in taken:
            for k in bins:
                xs, ys = [x[0] for x in k], [x[1] for x in k]
                if (abs(min(xs) - b[0]) < reach or abs(max(xs) - b[0]) < reach) and (abs(min(ys) - b[1]) < reach or abs(max(ys) - b[1]) < reach):
                    k.append(b)
                    break
            else:
                bins.append([b])
        taken = [(max(x[0] for x in k), max(x[1] for x in k), *np.mean([x[2:] for x in k], axis=0)) for k in bins]
    got = [(r.start // 10, r.end // 10, *(r[v] for v in O.VALUES)) for r in O.domains(cells, chroms, width, gap, smallest=8).collect()]
    assert len(got) == len(taken) > 5
    for a, b in zip(sorted(got), sorted(taken), strict=True):
        assert np.allclose(a, b)


def test_an_edge_inside_is_a_conflict():
    values = (1.0,) * 5
    out = O.without_conflicts([(10, 20, *values)], [(0, 9, *values), (9, 30, *values), (12, 19, *values), (20, 25, *values), (21, 40, *values), (30, 50, *values), (31, 39, *values)])
    assert [b[:2] for b in out] == [(10, 20), (0, 9), (12, 19), (21, 40), (31, 39)]


def test_no_cells_no_domains(spark):
    none = spark.createDataFrame([], CELLS)
    chroms = spark.createDataFrame([(1, 1000)], "idx long, len long")
    assert O.domains(none, chroms, 20, 2).count() == 0


def test_boxes_have_the_largest_score_of_their_windows(spark):
    rng = np.random.default_rng(4)
    n, width = 50, 20
    m = _planted(n, [4, 18, 35], rng, 6.0, 1.0)
    chroms = spark.createDataFrame([(1, n * 10)], "idx long, len long")
    boxes = [(1, a, a + 30, b, b + 40) for a in range(0, 400, 30) for b in range(a, min(a + 160, 460), 50)]
    asked = spark.createDataFrame(boxes * 2, "chr long, start1 long, end1 long, start2 long, end2 long")
    got = {(r.start1, r.end1, r.start2, r.end2): r.score for r in O.domain_scores(_cells(spark, m), chroms, asked, width, 2).collect()}
    want = {}
    for s in (0, 10, 20, 30):
        part = np.zeros((width + 1, width + 1))
        inside = m[s : s + width + 1, s : s + width + 1]
        part[: len(inside), : len(inside)] = inside
        score = dense.blocks(dense.directionality(part, 2)).score
        for _, a, b, x, y in boxes:
            if a // 10 >= s and y // 10 <= s + width:
                box = score[a // 10 - s : b // 10 - s, x // 10 - s : y // 10 - s]
                want[a, b, x, y] = max(want.get((a, b, x, y), -math.inf), box.max())
    assert any(v > 0 for v in want.values()) and set(got) == set(want)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_the_query_finds_the_folded_domains(spark):
    from plectra.plans import registry

    rows = registry.QUERIES["dom_sliding"](spark, "/root/testdata/sf0.01").collect()
    near = {(r.chr, round(r.start / 40_000)) for r in rows if abs(r.end - r.start - 40_000) <= 12_000}
    assert {(1, 1), (1, 2), (1, 3)} <= near, rows  # the first and last of a chromosome have no room around them
