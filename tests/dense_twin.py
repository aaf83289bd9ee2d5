"""Correlation and eigenvectors of a dense matrix, plainly: what the tiled and iterated ones are held against."""

import numpy as np


def pearson(oe: np.ndarray) -> np.ndarray:
    """Correlation of row pairs after the row means are taken off the columns; rows without cells are NaN."""
    occupied = (oe != 0).any(axis=0)
    out = np.full(oe.shape, np.nan)
    if not occupied.any():
        return out
    centred = oe.copy()
    centred[occupied] -= np.nanmean(oe, axis=1)[None, :]
    rows = centred[occupied]
    rows = rows - rows.mean(axis=1, keepdims=True)
    norm = np.sqrt((rows**2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = rows @ rows.T / np.outer(norm, norm)
    np.fill_diagonal(c, 1.0)
    place = np.flatnonzero(occupied)
    out[np.ix_(place, place)] = np.clip(c, -1, 1)
    return out


def eigenvector(correlation: np.ndarray, which: int = 0) -> np.ndarray:
    """The which-th eigenvector (largest eigenvalue first) of the valid part, NaN elsewhere.

    The sign is fixed: the entry with the largest magnitude (the first of equals) is positive.
    """
    valid = np.flatnonzero(np.nan_to_num(np.diag(correlation)) > 0.999)
    out = np.full(len(correlation), np.nan)
    if not len(valid):
        return out
    part = np.nan_to_num(correlation[np.ix_(valid, valid)])
    values, vectors = np.linalg.eigh(part)
    v = vectors[:, np.argsort(-values, kind="stable")[min(which, len(valid) - 1)]]
    peak = np.argmax(np.round(np.abs(v), 9))
    out[valid] = v if v[peak] >= 0 else -v
    return out
