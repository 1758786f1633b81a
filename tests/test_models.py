"""Fits, diagnostics of draws, common epochs and cluster overlaps against NumPy and plain loops."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest

from epochal.operators import asof, diagnostics, models

DAY = 86_400_000_000
NAN = float("nan")


# -- draws ------------------------------------------------------------------------------
def halves(chains):
    n = min(map(len, chains))
    return np.array([h for c in chains for h in (c[: n // 2], c[:n][n - n // 2 :])])


def scores(a):
    flat = a.ravel()
    rank = np.array([(flat < x).sum() + ((flat == x).sum() + 1) / 2 for x in flat])
    return np.array([NormalDist().inv_cdf(p) for p in (rank - 0.375) / (len(flat) + 0.25)]).reshape(a.shape)


def factor(a):
    n = a.shape[1]
    return math.sqrt((n * a.mean(1).var(ddof=1) / a.var(1, ddof=1).mean() + n - 1) / n)


def size(a):
    """Geyer's initial monotone sequence."""
    m, n = a.shape
    d = a - a.mean(1, keepdims=True)
    cov = np.array([[(c[: n - k] * c[k:]).sum() / n for k in range(n)] for c in d])
    mean_var = cov[:, 0].mean() * n / (n - 1)
    var = mean_var * (n - 1) / n + (a.mean(1).var(ddof=1) if m > 1 else 0)
    if not var > 1e-300:
        return float(m * n)
    rho = np.zeros(n)
    even, odd = 1.0, 1 - (mean_var - cov[:, 1].mean()) / var
    rho[0], rho[1], t = even, odd, 1
    while t < n - 3 and even + odd > 0:
        even, odd = (1 - (mean_var - cov[:, t + k].mean()) / var for k in (1, 2))
        if even + odd >= 0:
            rho[t + 1], rho[t + 2] = even, odd
        t += 2
    last = t - 2
    if even > 0:
        rho[last + 1] = even
    t = 1
    while t <= last - 2:
        if rho[t + 1] + rho[t + 2] > rho[t - 1] + rho[t]:
            rho[t + 1] = rho[t + 2] = (rho[t - 1] + rho[t]) / 2
        t += 2
    tau = max(-1 + 2 * rho[: last + 1].sum() + rho[last + 1 : last + 2].sum(), 1 / math.log10(m * n))
    return m * n / tau


def walk(seed, n, memory, shift=0.0):
    rng = np.random.default_rng(seed)
    out = [rng.normal()]
    for _ in range(n - 1):
        out.append(memory * out[-1] + rng.normal())
    return np.array(out) + shift


def test_diagnostics_of_draws(spark):
    own = {
        1: [walk(s, 60, 0.0) for s in range(4)], 2: [walk(s, 301, 0.97) for s in range(2)], 3: [walk(5, 40, 0.5), walk(6, 44, 0.5, 3.0)],
        4: [np.round(walk(7, 50, 0.3)), np.round(walk(8, 50, 0.3))], 5: [walk(9, 4, 0.0), walk(10, 4, 0.0)], 6: [np.ones(8), np.ones(8)],
    }
    rows = [(o, c, k, float(x), 1) for o, chains in own.items() for c, chain in enumerate(chains) for k, x in enumerate(chain)]
    odd = [(None, 0, 0, 1.0, 1), (1, None, 0, 1.0, 1), (1, 0, 999, None, 1), (1, 0, 998, NAN, 1), (7, 0, 0, 1.0, 1), (7, 0, 1, 2.0, 1)]
    got = {r.object: r for r in diagnostics.summary(spark.createDataFrame(rows + odd, "object long, chain int, draw long, x double, n int").repartition(3)).collect()}
    assert set(got) == set(own)
    for o, chains in own.items():
        a = halves(chains)
        low, high = np.quantile(a, 0.05), np.quantile(a, 0.95)
        assert got[o].n == a.size and got[o].ess_bulk == pytest.approx(size(scores(a)))
        assert got[o].ess_mean == pytest.approx(size(a)) and got[o].ess_tail == pytest.approx(min(size((a <= low) * 1.0), size((a <= high) * 1.0)))
        assert got[o].mcse_mean == pytest.approx(a.std(ddof=1) / math.sqrt(size(a)))
        if o != 6:
            assert got[o].rhat == pytest.approx(max(factor(scores(a)), factor(scores(abs(a - np.median(a))))))
    assert got[6].rhat is None and got[2].ess_bulk < 60 < got[1].ess_bulk and got[3].rhat > 1.3


# -- fits -------------------------------------------------------------------------------
def test_linear_fits(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for o in (1, 2, 3):
        x = rng.normal(size=(30, 3)) * [1, 50, 1e-3] + [0, 1e4, 5]
        y = 2 + x @ [3.0, -0.5, 100.0] + 0.1 * rng.normal(size=30)
        if o == 3:
            x[:, 2] = 2 * x[:, 0]
        rows += [(o, float(b), *map(float, a), 1) for a, b in zip(x, y, strict=True)]
        beta, *_ = np.linalg.lstsq(np.column_stack((np.ones(30), x)), y, rcond=None)
        want[o] = (*beta, np.sqrt(np.mean((y - np.column_stack((np.ones(30), x)) @ beta) ** 2)))
    rows += [(1, None, 1.0, 1.0, 1.0, 1), (1, 1.0, NAN, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 1.0, 1), (4, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "object long, y double, p double, q double, r double, n int")
    fit = models.linear_fit(df, "y", ["p", "q", "r"])
    got = {r.object: r for r in fit.collect()}
    for o in (1, 2):
        assert (got[o].intercept, got[o].b_p, got[o].b_q, got[o].b_r, got[o].sigma) == pytest.approx(want[o], rel=1e-6) and got[o].n == 30
    assert got[3].b_r is None and got[4].b_p is None and got[None].intercept is None
    rows = models.predicted(df.where("object = 1"), fit, ["p", "q", "r"]).where("y IS NOT NULL AND NOT isnan(p)").collect()
    assert all(abs(r.predicted - r.y) < 1 for r in rows)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_autoregressions(spark, order):
    own = {1: walk(1, 80, 0.6), 2: walk(2, 200, -0.4), 3: walk(3, 2 * order, 0.1), 4: np.zeros(20), 5: walk(5, 2 * order + 1, 0.5)}
    rows = [(o, k * DAY, k, float(x), 1) for o, v in own.items() for k, x in enumerate(v)] + [(1, 500 * DAY, 1, None, 1), (1, 501 * DAY, 1, NAN, 1), (None, 0, 0, 1.0, 1)]
    df = spark.createDataFrame(rows, "object long, t long, rec long, value double, i int")
    fit = models.ar_fit(df, order)
    got = {r.object: r for r in fit.collect()}
    assert set(got) == {1, 2, 4, 5}
    for o in (1, 2):
        v = own[o]
        z = np.column_stack([v[order - 1 - j : len(v) - 1 - j] for j in range(order)])
        a = np.linalg.lstsq(z, v[order:], rcond=None)[0]
        assert [got[o][f"a{j}"] for j in range(order)] == pytest.approx(list(a)) and got[o].sigma == pytest.approx(np.sqrt(np.mean((v[order:] - z @ a) ** 2)))
        assert got[o].last == list(v[-order:])
        run = list(v)
        for _ in range(6):
            run.append(sum(a[j] * run[-1 - j] for j in range(order)))
        ahead = sorted((r.step, r.expected) for r in models.ar_forecast(fit, order, 6).where(f"object = {o}").collect())
        assert [x for _, x in ahead] == pytest.approx(run[-6:])
    assert got[4].a0 is None


# -- clusters ---------------------------------------------------------------------------
def test_cluster_overlap(spark):
    rng = np.random.default_rng(3)
    rows, own = [], {}
    for g in range(7):
        centre = np.array([6900 + 4 * g + (300 if g == 6 else 0), math.pi - 0.02 * g, 0.1 * (g % 2)])
        for c in range(3 if g else 2):
            size_ = 1 if g == 2 else 6
            z = centre + rng.normal(size=(size_, 3)) * [3, 0.1, 0.1]
            z[:, 1:] = (z[:, 1:] + np.pi) % (2 * np.pi) - np.pi
            rows += [(f"g{g}", c * 10, m, *map(float, p), 1) for m, p in enumerate(z)]
            near = z.copy()
            for k in (1, 2):
                near[:, k] = np.arctan2(np.sin(z[:, k] - z[0, k]), np.cos(z[:, k] - z[0, k])) + z[0, k]
            own[f"g{g}", c] = (near.mean(0), np.cov(near.T) if size_ > 1 else np.diag(models.SINGLE))
    rows += [(None, 0, 1, 1.0, 1.0, 1.0, 1), ("g0", 0, 9, None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, c int, m int, a double, o double, l double, k int")
    env = models.envelopes(df, "g", "c", "m", "a", "o", "l")
    got = {(r.a, r.b): (r.checkpoints, r.penalty, r.closest) for r in models.cluster_overlap(env, "g", "c").collect()}
    want = {}
    for a, b in itertools.combinations([f"g{g}" for g in range(7)], 2):
        n = min(sum(k[0] == x for k in own) for x in (a, b))
        risks = []
        for c in range(n):
            d = own[a, c][0] - own[b, c][0]
            d[1:] = np.arctan2(np.sin(d[1:]), np.cos(d[1:]))
            risks.append(math.exp(-0.5 * d @ np.linalg.inv(own[a, c][1] + own[b, c][1] + np.diag(models.RIDGE)) @ d))
        if max(risks) > 0.01:
            want[a, b] = (n, sum(max(0.0, r - 0.01) ** 2 for r in risks) / n, max(risks))
    assert want and len(want) < 21
    assert got == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}
    one = env.where("g = 'g2'").first()
    assert (one.members, one.c00, one.c12, one.c22) == (1, 25.0, 0.0, 0.0025)


# -- common epochs ----------------------------------------------------------------------
def test_common_epochs(spark):
    rng = np.random.default_rng(4)
    rows = [(o, int(t), k) for o in range(1, 6) for k, t in enumerate(rng.integers(0, 400, size=12))]
    df = spark.createDataFrame([*rows, (None, 3, 1), (1, None, 1)], "object long, t long, rec long")
    own = {o: [t for p, t, _ in rows if p == o] for o in range(1, 6)}
    best = min((max(g := [min(abs(t - e) for t in own[o]) for o in own]), sum(g), e) for e in own[2])
    got = asof.nearest_intersection(df, 2).collect()
    assert {r.object for r in got} == set(own) and {(r.epoch, r.worst) for r in got} == {(best[2], best[0])}
    assert all(abs(r.near_t - r.epoch) == min(abs(t - r.epoch) for t in own[r.object]) for r in got)
    assert asof.nearest_intersection(df, 2, tolerance=best[0]).count() == 5
    assert asof.nearest_intersection(df, 2, tolerance=0).collect() == [] and asof.nearest_intersection(df, 77).collect() == []
    shared = spark.createDataFrame([*rows, *((o, 999, 50 + k) for o in own for k in range(2)), *((o, 1001, 1) for o in own), (None, 999, 1)], "object long, t long, rec long")
    common = min(set.intersection(*(set(v) | {999, 1001} for v in own.values())))
    out = sorted(map(tuple, asof.exact_intersection(shared).collect()))
    assert out == [(o, common, max(k for p, t, k in [*rows, *((o, 999, 51) for o in own)] if p == o and t == common)) for o in own]
    assert asof.exact_intersection(df.where("object IS NULL")).collect() == []


def test_rows_without_key_or_time_have_no_nearest_row(spark):
    left = spark.createDataFrame([(1, None, 1), (None, 5, 2), (1, 5, 3), (None, None, 4)], "object long, t long, id long")
    right = spark.createDataFrame([(1, 4, 10, 1.0), (1, None, 11, 2.0), (None, 5, 12, 3.0)], "object long, t long, rec long, value double")
    assert {r.id: r.near_rec for r in asof.nearest(left, right).collect()} == {1: None, 2: None, 3: 10, 4: None}
    assert {r.id: r.interpolated_value for r in asof.interpolated(left, right).collect()} == {1: None, 2: None, 3: None, 4: None}


def test_distances_between_objects_in_blocks(spark, monkeypatch):
    from epochal.operators import posterior

    monkeypatch.setattr(posterior, "BLOCK_OBJECTS", 4)
    rng = np.random.default_rng(9)
    own = {o: rng.normal(size=rng.integers(1, 30)) + o % 3 for o in range(17)}
    df = spark.createDataFrame([(o, float(x)) for o, v in own.items() for x in v] + [(None, 1.0), (99, None)], "object long, x double")
    q = {o: np.quantile(v, np.arange(1, 20) / 20) for o, v in own.items()}
    want = {(a, b): abs(q[a] - q[b]).mean() for a in own for b in own if a < b}
    assert {(r.a, r.b): r.w1 for r in posterior.wasserstein(df).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    near = {}
    for r in posterior.nearest_objects(df, 3).collect():
        near.setdefault(r.object, []).append((r["rank"], r.other))
    for o in own:
        first = sorted((round(want[min(o, p), max(o, p)], 6), p) for p in own if p != o)[:3]
        assert sorted(near[o]) == [(k + 1, p) for k, (_, p) in enumerate(first)]
