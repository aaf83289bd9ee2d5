"""Dense kernels on one chromosome's matrix."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def dense(i: np.ndarray, j: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Symmetric n by n matrix of upper-triangle cells."""
    out = np.zeros((n, n))
    out[i, j] = values
    out[j, i] = values
    return out


def directionality(m: np.ndarray, gap: int = 7) -> np.ndarray:
    """(A - B) / (A + B) of each row and distance, upstream against downstream.

    Distances begin at the gap and end that far from the nearer edge; elsewhere, and where both cells are empty, it is 0.
    """
    n = len(m)
    out = np.zeros((n, n))
    for d in range(gap, n):
        i = np.arange(d + gap, n - gap - d + 1)
        if not len(i):
            break
        a, b = m[i, i - d], m[i, i + d]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i, i + d] = np.where(a + b > 0, (a - b) / (a + b), 0.0)
    return out


class Blocks(NamedTuple):
    """A matrix each: a block's score; the variances of its upper and lower triangle; the agreement of their signs."""

    score: np.ndarray
    up_var: np.ndarray
    lo_var: np.ndarray
    up_sign: np.ndarray
    lo_sign: np.ndarray


def _means(x: np.ndarray, cells: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the upper and lower triangle of each block [a, b], divided by their numbers of cells where given.

    The upper triangle ends at the block's last column: row a + t holds columns a + 2t + 1 to b. The lower one begins behind it:
    a row r up to b holds columns b + 1 to 2r - a. Both grow from block to block of a row of the result: the upper by the
    upper half of column b; the lower by row b from the diagonal on, less the lower half of column b. So each is a running sum.
    """
    n = len(x)
    columns, rows = np.pad(x, ((1, 0), (0, 0))).cumsum(0), np.pad(x, ((0, 0), (1, 0))).cumsum(1)
    up, lo = np.zeros((n, n)), np.zeros((n, n))
    for a in range(n - 1):
        b = np.arange(a + 1, n)
        half = columns[a + (b - a + 1) // 2, b]
        up[a, b] = (half - columns[a, b]).cumsum()
        lo[a, b] = (rows[b, np.minimum(2 * b - a, n - 1) + 1] - rows[b, b] - columns[b + 1, b] + half).cumsum()
    if cells is not None:
        up /= cells[0]
        lo /= cells[1]
    return up, lo


def _scaled(m: np.ndarray) -> np.ndarray:
    top = m.max(initial=0.0)
    return m / top if top > 0 else np.zeros_like(m)


def blocks(d: np.ndarray) -> Blocks:
    """Scores of all blocks of a matrix of directionality.

    Directionality is under 0 in the upper triangle of a domain and over 0 in the lower one. The score adds the differences of the triangles' means
    and of their mean signs, and takes away their variances, each over the largest of the matrix.
    """
    cells = tuple(np.maximum(c, 1.0) for c in _means(np.ones_like(d)))
    up, lo = _means(d, cells)
    score = _scaled(lo - up)
    up_sign, lo_sign = _means(np.sign(d), cells)
    score += _scaled(lo_sign - up_sign)
    up_var, lo_var = _means(d * d, cells)
    up_var -= up * up
    lo_var -= lo * lo
    for v in (up_var, lo_var):
        v[v < 1e-12] = 0.0  # rounding errors of equal values
    return Blocks(score - _scaled(up_var + lo_var), up_var, lo_var, -up_sign, lo_sign)


def corners(b: Blocks, sign: float, variance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Strongest blocks of the 8-connected patches of positive scores, in row order; of equal scores the first.

    Blocks count whose signs agree at least by `sign` and whose variances add up to at most `variance`.
    """
    good = (b.score > 0) & (b.up_sign >= sign) & (b.lo_sign >= sign)
    if variance is not None:
        good &= b.up_var + b.lo_var <= variance
    i, j = np.nonzero(good)
    label = components8(good)[i, j]
    by = np.lexsort((j, i, -b.score[i, j], label))
    first = by[np.flatnonzero(np.diff(label[by], prepend=0))]
    first = first[np.lexsort((j[first], i[first]))]
    return i[first], j[first]


def components8(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1, 0 outside, in row order) of 8-connected components, by union-find over runs of a row's cells."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]  # one past the run
    wide = mask.shape[1] + 3
    begins, ends = row * wide + first, row * wide + last
    parent = list(range(len(row)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # runs of the row above that end at this one's first cell or later, and begin at its last cell's right neighbour or earlier
    low, high = np.searchsorted(ends, begins - wide, "left"), np.searchsorted(begins, ends - wide, "right")
    for k, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for near in range(x, y):
            a, b = root(k), root(near)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(row))], np.int64)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(names, last - first)
    return out
