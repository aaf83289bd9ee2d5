"""Balancing against the same algorithms over dense arrays, written out plainly."""

import math

import numpy as np
import pytest

from plectra.operators import balancing as K
from plectra.operators import norm

COLUMNS = "chr1 long, chr2 long, bin_size long, bin_x long, bin_y long, counts double"


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """Rounds are many and their tables tiny here."""
    set_to = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def frame(spark, matrices):
    rows = [(c, c, 10, i, j, float(m[i, j])) for c, m in matrices.items() for i in range(len(m)) for j in range(i, len(m)) if m[i, j]]
    return spark.createDataFrame(rows, COLUMNS).coalesce(2)


def vectors(df, matrices):
    got = {c: np.full(len(m), np.nan) for c, m in matrices.items()}
    for r in df.collect():
        got[r.chr][r.bin] = r.value
    return got


def newton(a, tol=1e-6, delta=0.1, stalls=100):
    n = len(a)
    e = np.ones(n)
    x, eta, rt = e.copy(), 0.1, tol**2
    v = x * (a @ x)
    rk = 1 - v
    rho1 = rho2 = rk @ rk
    rout = rold = rho1
    same = 0
    while rout > rt and same < stalls:
        k, y = 0, e.copy()
        enough = max(eta**2 * rout, rt)
        while rho1 > enough:
            k += 1
            if k == 1:
                z = rk / v
                p = z.copy()
                rho1 = rk @ z
            else:
                p = z + rho1 / rho2 * p
            w = x * (a @ (x * p)) + v * p
            alpha = rho1 / (p @ w)
            ynew = y + alpha * p
            if ynew.min() <= delta:
                ap = alpha * p
                y = y + ((delta - y[ap < 0]) / ap[ap < 0]).min() * ap
                break
            y, rk = ynew, rk - alpha * w
            rho2, z = rho1, rk / v
            rho1 = rk @ z
        x = x * y
        v = x * (a @ x)
        rk = 1 - v
        rho1 = rk @ rk
        same += abs(rho1 - rout) < 1e-6
        rat, rold, rout = rho1 / rold if rold else 0, rho1, rho1
        before, eta = eta, 0.9 * rat
        if 0.9 * before**2 > 0.1:
            eta = max(eta, 0.9 * before**2)
        eta = max(min(eta, 0.1), 0.5 * tol / math.sqrt(rout) if rout else math.inf)
    return None if same >= stalls else x


def kr(a, stalls=100):
    n, total = len(a), a.sum(1)

    def rows_over(percent):
        s = np.sort(total[total != 0])
        at = percent / 100 * (len(s) + 1)
        at = min(max(at, 1), len(s))
        low = s[math.floor(at) - 1]
        limit = low + (at - math.floor(at)) * (s[math.ceil(at) - 1] - low) if percent else 0
        return np.flatnonzero(total > limit)

    use = rows_over(0)
    for attempt in range(1, 7):
        sub = a[np.ix_(use, use)]
        x = newton(sub, stalls=stalls)
        if x is None or attempt == 5:
            use = rows_over(attempt if attempt < 5 else 10)
            continue
        factor = math.sqrt((x * (sub @ x)).sum() / sub.sum())
        tiny = factor / x < 0.01
        if not tiny.any():
            out = np.full(n, np.nan)
            out[use] = factor / x
            return out
        use = use[~tiny]
    return np.full(n, np.nan)


def scale(a, z=None, tol=5e-4, share=1e-4, growth=5e-5):
    n = len(a)
    z = np.ones(n) if z is None else z.copy()
    cells = (a != 0).sum(1)
    r0 = np.sort(cells[cells > 0])
    low = r0[int(max(0, len(r0) * share + 0.5))]
    one = np.where(z == 0, 0.0, 1.0)
    bad = ((cells < low) & (z > 0)) | np.isnan(z)
    z[bad] = 1
    row = row0 = a @ one
    off = bad | (z == 0)
    dr = 1.0 - bad
    dc, was = dr.copy(), dr.copy()
    ber = err = 10 * (1 + tol)
    it = every = 0
    errors, sums = [], []
    with np.errstate(all="ignore"):
        while (ber > tol or err > 5 * tol) and it < 100 and every < 300 and share <= 0.2:
            it, every = it + 1, every + 1
            dr = dr * z / np.where(off, 1, row)
            dc = dc * z / np.where(off, 1, (a @ dr) * dc)
            row = (a @ dc) * dr
            b = np.sqrt(dr * dc)
            ber = np.nanmax(np.abs(b - was)[~off], initial=0)
            errors.append(ber)
            if it % 10 == 0:
                err = np.nanmax(np.abs((a @ b) * b - z)[~off], initial=0)
                sums.append(err)
            was = b
            if ber < tol and (len(sums) < 2 or sums[-1] < 0.5 * sums[-2]) or it <= 5:
                continue
            stalled = not any(errors[-k] * 1.02 < errors[-k - 1] for k in range(1, 6)) or len(sums) >= 2 and sums[-1] > 0.75 * sums[-2] or it >= 100
            if stalled:
                share, sums = share + growth, []
                low = r0[int(max(0, len(r0) * share + 0.5))]
                more = (cells < low) & (z > 0)
                bad, off, z = bad | more, off | more, np.where(more, 1, z)
                ber = err = 10 * (1 + tol)
                if errors[-1] > errors[-6]:
                    dr = 1.0 - bad
                    dc, was, row = dr.copy(), dr.copy(), row0
                else:
                    dr, dc = dr * ~bad, dc * ~bad
                it = 0
    b = np.where(bad | ~(b > 0), np.nan, b)
    v = np.nan_to_num(b)
    return math.sqrt(v @ a @ v / a[np.ix_(v > 0, v > 0)].sum()) / b


def block(seed, n, fill=1.0):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.integers(1, 20, (n, n)) * (rng.random((n, n)) < fill)).astype(float)
    return m + np.triu(m, 1).T


def decayed(seed, n):
    """A map like real ones: counts fall with distance, some rows are nearly empty."""
    rng = np.random.default_rng(seed)
    i, j = np.indices((n, n))
    m = np.triu(rng.poisson(60 / (1 + np.abs(i - j)))).astype(float)
    m[:, 3] *= rng.random(n) < 0.2
    return m + np.triu(m, 1).T


def test_knight_ruiz(spark):
    matrices = {1: block(1, 12), 2: decayed(2, 30)}
    got = vectors(K.knight_ruiz(frame(spark, matrices)), matrices)
    for c, m in matrices.items():
        np.testing.assert_allclose(got[c], kr(m), rtol=1e-7)
        good = ~np.isnan(got[c])
        sums = (m := matrices[c][np.ix_(good, good)] / np.outer(got[c][good], got[c][good])).sum(1)
        assert np.ptp(sums) < 1e-5 * sums.mean() and m.size


def test_no_unbalanced_vector_is_returned(spark):
    """No scaling balances a star: all six attempts fail."""
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert np.isnan(kr(star, stalls=1)).all()
    assert np.isnan(vectors(K.knight_ruiz(frame(spark, {1: star}), stalls=1), {1: star})[1]).all()


def test_rows_of_the_smallest_sums_go(spark):
    matrices = {1: decayed(7, 60)}
    a = K.Matrices(frame(spark, matrices))
    total = matrices[1].sum(1)
    for percent in (1, 2, 4, 10):
        s = np.sort(total[total != 0])
        at = min(max(percent / 100 * (len(s) + 1), 1), len(s))
        limit = s[math.floor(at) - 1] + (at % 1) * (s[math.ceil(at) - 1] - s[math.floor(at) - 1])
        assert sorted(r.bin for r in K._largest(a, {0}, percent).collect()) == np.flatnonzero(total > limit).tolist()


def test_scale(spark):
    matrices = {1: block(1, 12), 2: decayed(2, 30)}
    got = vectors(K.scale(frame(spark, matrices)), matrices)
    for c, m in matrices.items():
        np.testing.assert_allclose(got[c], scale(m), rtol=1e-7)


def test_scale_grows_on_a_stall(spark):
    """A full block with a tail of rows of one or two cells: it stalls until the tail is out."""
    m = np.zeros((44, 44))
    m[:40, :40] = block(4, 40)
    for k in range(39, 43):
        m[k, k + 1] = m[k + 1, k] = 1
    got = vectors(K.scale(frame(spark, {1: m}), growth=0.1), {1: m})[1]
    due = scale(m, growth=0.1)
    np.testing.assert_allclose(got, due, rtol=1e-6)
    assert np.isnan(due[40:]).all() and not np.isnan(due[:40]).any()


def test_scale_to_a_target(spark):
    m = block(5, 10)
    z = np.array([1, 2, 1, 3, 0, np.nan, 1, 1, 2, 1.0])
    rows = [(10, 1, k, float(x)) for k, x in enumerate(z) if x == x]
    target = spark.createDataFrame(rows, "bin_size long, chr long, bin long, value double")
    got = vectors(K.scale(frame(spark, {1: m}), target), {1: m})[1]
    np.testing.assert_allclose(got, scale(m, z), rtol=1e-7)
    assert np.isnan(got[[4, 5]]).all() and not np.isnan(np.delete(got, [4, 5])).any()


@pytest.mark.parametrize("name", ["GW_VC", "INTER_VC", "GW_SCALE"])
def test_genome_wide_forms(spark, name):
    sizes = {1: 60, 2: 50}
    rng = np.random.default_rng(8)
    n1, n2 = 7, 6
    m = np.triu(rng.integers(1, 20, (n1 + n2, n1 + n2))).astype(float)
    m += np.triu(m, 1).T
    at = [(1, k) for k in range(n1)] + [(2, k) for k in range(n2)]
    rows = [(*sorted((at[i][0], at[j][0])), 10, at[i][1], at[j][1], float(m[i, j])) for i in range(len(at)) for j in range(i, len(at))]
    chroms = spark.createDataFrame(list(sizes.items()), "idx long, len long")
    whole = m.copy()
    if name.startswith("INTER"):
        whole[:n1, :n1] = whole[n1:, n1:] = 0
    if name.endswith("VC"):
        due = whole.sum(1)
        due = due * math.sqrt((whole / np.outer(due, due)).sum() / whole.sum())
    else:
        due = kr(whole) if name.endswith("KR") else scale(whole)
    got = {(r.chr, r.bin): r.value for r in K.balanced(spark.createDataFrame(rows, COLUMNS), chroms, name).collect()}
    np.testing.assert_allclose([got[k] for k in at], due, rtol=1e-6)


def test_names_and_empty_maps(spark):
    empty = spark.createDataFrame([], COLUMNS)
    chroms = spark.createDataFrame([(1, 60)], "idx long, len long")
    for name in ("KR", "SCALE", "VC", "VC_SQRT"):
        assert K.balanced(empty, chroms, name).collect() == []
    with pytest.raises(ValueError, match="known"):
        K.balanced(empty, chroms, "GW_VC_SQRT")
    assert norm.split_vector(empty.selectExpr("bin_size", "chr1 as chr", "bin_x as bin", "counts as value"), chroms).collect() == []
