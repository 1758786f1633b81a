"""Peaks of spectra and grids, and spectra of pairs, against plain versions."""

import math
import random

import numpy as np
import pytest

from epochal.operators import peaks, spectra

DAY = 86_400_000_000


def plain_peaks(v, top, least, distance):
    """Middle of every plateau above both sides; prominence by walking; greedy by height."""
    found, i, n = [], 1, len(v)
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found.sort(key=lambda p: (v[p], p), reverse=True)
    kept = []
    for p in found:
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def prominence(p):
        low = []
        for side in (range(p, -1, -1), range(p, n)):
            least_seen = v[p]
            for q in side:
                if v[q] > v[p]:
                    break
                least_seen = min(least_seen, v[q])
            low.append(least_seen)
        return v[p] - max(low)

    out = [(p, v[p], prominence(p)) for p in kept]
    return [x for x in out if least is None or x[2] >= least][:top]


@pytest.mark.parametrize(("top", "least", "distance"), [(5, None, 1), (50, 2.0, 1), (4, None, 3), (50, 1.0, 6)])
def test_spectral_peaks(spark, top, least, distance):
    rng = random.Random(2)
    own = {o: [float(rng.randint(0, 9)) for _ in range(n)] for o, n in enumerate([0, 1, 2, 3, 3, 10, 40, 80])}
    own |= {20: [1.0] * 9, 21: [0.0, 2.0, 2.0, 2.0, 1.0], 22: [3.0, 1.0, 2.0, 2.0]}
    rows = [(o, k / 8, x, "clash", 1) for o, v in own.items() for k, x in enumerate(v)] + [(5, None, 99.0, "x", 1), (5, 99.0, None, "x", 1), (6, 99.0, float("nan"), "x", 1)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "object long, frequency double, amplitude double, rank string, bin int")
    got = {}
    for r in peaks.spectral_peaks(df, top, least, distance).collect():
        got.setdefault(r.object, []).append((r.rank, r.bin, r.amplitude, r.prominence))
        assert r.frequency == r.bin / 8
    want = {o: [(k + 1, *x) for k, x in enumerate(plain_peaks(v, top, least, distance))] for o, v in own.items()}
    assert {o: sorted(v) for o, v in got.items()} == {o: v for o, v in want.items() if v}


def plain_hotspots(grid, top, di, dj, around):
    high = [c for c, v in grid.items() if all(grid.get((c[0] + a, c[1] + b), -1) <= v for a in (-1, 0, 1) for b in (-1, 0, 1))]
    kept = []
    for c in sorted(high, key=lambda c: (-grid[c], c)):
        if len(kept) < top and not any(min(abs(c[0] - k[0]), around - abs(c[0] - k[0])) < di and abs(c[1] - k[1]) < dj for k in kept):
            kept.append(c)
    return kept


def test_hotspots(spark):
    rng = random.Random(4)
    grids = {g: {(i, j): rng.randint(1, 12) for i in range(12) for j in range(8) if rng.random() < 0.8} for g in range(5)}
    grids[9] = {(0, 0): 3}
    rows = [(g, i, j, v, 7) for g, own in grids.items() for (i, j), v in own.items()] + [(9, 5, 5, None, 7)]
    df = spark.createDataFrame(rows, "g long, i int, j int, n long, rank int").drop("rank")
    for top, di, dj in ((5, 2, 2), (40, 3, 2), (40, 0, 0)):
        got = sorted((r.g, r["rank"], r.i, r.j) for r in peaks.hotspots(df, "n", top, di, dj, around_i=12, keys=("g",)).collect())
        assert got == sorted((g, k + 1, *c) for g, own in grids.items() for k, c in enumerate(plain_hotspots(own, top, di, dj, 12)))
    one = peaks.hotspots(df.where("g = 0").drop("g"), "n", 3, around_i=12).collect()
    assert [(r.i, r.j) for r in sorted(one, key=lambda r: r["rank"])] == plain_hotspots(grids[0], 3, 2, 2, 12)
    mid = float(np.median(list(grids[1].values())))
    strong = peaks.hotspots(df.where("g = 1"), "n", 40, 0, 0, around_i=12, keys=("g",), least=3.0).collect()
    assert {(r.i, r.j) for r in strong} == {c for c in plain_hotspots(grids[1], 99, 0, 0, 12) if grids[1][c] - mid >= 3}
    assert peaks.hotspots(df.limit(0), "n", keys=("g",)).collect() == []


def test_persistence_of_a_hotspot_that_crosses_the_seam(spark):
    rows = [(0, 17, 3, 1, 5), (1, 0, 4, 1, 5), (2, 1, 5, 1, 5), (2, 17, 3, 2, 4), (3, 9, 3, 1, 5)]
    df = spark.createDataFrame(rows, "w long, i int, j int, rank int, n long")
    r = peaks.persistence(df, "w", 18, 1, 1).first()
    assert (r.n_windows, r.share_near) == (4, 0.75) and r.drift_i == pytest.approx((1 + 1 + 8) / 3) and r.drift_j == 0
    single = peaks.persistence(df.where("w = 0"), "w", 18, 1, 1).first()
    assert (single.n_windows, single.drift_i, single.share_near) == (1, None, 1.0)


# -- pairs ------------------------------------------------------------------------------
def welch(x, y, cadence, segment):
    """Cross density and coherence by FFT of half-overlapping periodic Hann segments."""
    width = min(segment, len(x))
    step = width - width // 2
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    parts = [slice(s, s + width) for s in range(0, len(x) - width + 1, step)]
    fx, fy = ([np.fft.rfft((v[p] - v[p].mean()) * h) for p in parts] for v in (x, y))
    xy, xx, yy = (np.mean([np.conj(a) * b for a, b in zip(p, q, strict=True)], axis=0) for p, q in ((fx, fy), (fx, fx), (fy, fy)))
    both = np.full(width // 2 + 1, 2.0)
    both[0] = 1
    if width % 2 == 0:
        both[-1] = 1
    return np.arange(width // 2 + 1) / (width * cadence), xy * both * cadence / (h * h).sum(), np.abs(xy) ** 2 / (xx.real * yy.real)


def pair(seed, n):
    rng = np.random.default_rng(seed)
    x = np.sin(np.arange(n) * 0.7) + 0.3 * rng.normal(size=n)
    return x, np.roll(x, 2) + 0.5 * rng.normal(size=n)


def panel(spark, own):
    rows = [(o, int(k * DAY), k, float(a), float(b), 1) for o, (x, y) in own.items() for k, (a, b) in enumerate(zip(x, y, strict=True))]
    odd = [(None, 0, 1, 1.0, 1.0, 1), (1, None, 1, 1.0, 1.0, 1), (1, DAY // 2, 5, None, 1.0, 1), (1, DAY // 3, 5, float("nan"), 1.0, 1), (1, 0, 99, 50.0, 50.0, 1)]
    return spark.createDataFrame(rows + odd, "object long, t long, rec long, x double, y double, k int")


def test_cross_spectrum_equals_transforms(spark):
    own = {1: pair(1, 100), 2: pair(2, 33), 3: pair(3, 16), 4: pair(4, 7), 5: (np.ones(40), pair(5, 40)[1])}
    got = {}
    for r in spectra.cross_spectrum(panel(spark, own), "x", "y", 1.0, segment=32).collect():
        got.setdefault(r.object, []).append((r.frequency, r.csd_real, r.csd_imag, r.coherence))
    assert set(got) == {1, 2, 3, 5}
    for o in (1, 2, 3):
        f, xy, coherence = welch(*own[o], 1.0, 32)
        assert np.array(sorted(got[o])) == pytest.approx(np.stack([f, xy.real, xy.imag, coherence], axis=1), abs=1e-9)
    assert max(abs(c) for r in got[5] for c in r[1:3]) < 1e-9
    mean = spectra.averaged(spectra.cross_spectrum(panel(spark, own), "x", "y", 1.0, segment=32), "frequency", "coherence")
    assert {r.frequency: r.n_objects for r in mean.collect()}[0.0] == 4


def test_lag_correlations_equal_products(spark):
    own = {1: pair(1, 50), 2: pair(2, 6), 3: pair(3, 3)}
    for overlap in (False, True):
        got = {(r.object, r.lag): r.r for r in spectra.lag_correlations(panel(spark, own), "x", "y", 1.0, 8, overlap).collect()}
        want = {}
        for o in (1, 2):
            x, y = (v - v.mean() for v in own[o])
            full = np.correlate(x, y, "full") / (x.std() * y.std())
            for k in range(-min(8, len(x) - 1), min(8, len(x) - 1) + 1):
                want[o, k] = full[k + len(x) - 1] / (len(x) - abs(k) if overlap else len(x))
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    mean = {r.lag: (r.n_objects, r.r) for r in spectra.mean_lag_correlation(spectra.lag_correlations(panel(spark, own), "x", "y", 1.0, 8)).collect()}
    assert set(mean) == set(range(-5, 6)) and all(n == 2 for n, _ in mean.values())


def test_stack_with_the_same_counts(spark):
    rng = np.random.default_rng(7)
    own = {o: [(k / (8 + o % 3), float(rng.random())) for k in range(1, 6)] for o in range(1, 30)}
    own |= {40: [(0.1, 1.0)], 41: [(0.1, 0.0), (0.2, 0.0)]}
    rows = [(o, f, a, 1) for o, v in own.items() for f, a in v] + [(None, 0.1, 5.0, 1), (1, 0.15, None, 1)]
    df = spark.createDataFrame(rows, "object long, frequency double, amplitude double, replicate int")
    got = {r.frequency: (r.n_members, r.amplitude, r.p05, r.p95) for r in spectra.stacked_spectrum(df, 16).collect()}
    import hashlib

    def times(o, b):
        u = int(hashlib.md5(f"{o}:{b}".encode()).hexdigest()[:8], 16) / 2**32
        return sum(u >= share for share in spectra.DRAWN)

    for f, _ in own[1]:
        y = {}
        for o, v in own.items():
            fs, amplitudes = zip(*v, strict=True)
            if len(v) > 1 and fs[0] <= f <= fs[-1]:
                y[o] = np.interp(f, fs, amplitudes) / (max(amplitudes) or 1.0)
        medians = [np.median([x for o, x in y.items() for _ in range(times(o, b))]) for b in range(16)]
        assert got[f] == pytest.approx((len(y), np.median(list(y.values())), np.percentile(medians, 5), np.percentile(medians, 95)))
    counts = [times(o, b) for o in range(300) for b in range(10)]
    assert abs(np.mean(counts) - 1) < 0.1 and abs(np.var(counts) - 1) < 0.15


def test_dominant_frequencies_of_windows(spark):
    t = np.arange(120)
    x = np.where(t < 64, np.sin(2 * np.pi * t / 8), np.sin(2 * np.pi * t / 4))
    out = spectra.dominant_frequencies(panel(spark, {2: (x, x), 3: (x[:20], x[:20])}), 1.0, window=32, step=16, value="x")
    got = sorted((r.object, r.s, r.frequency) for r in out.collect())
    assert [g[:2] for g in got] == [(2, s) for s in range(6)]
    assert [g[2] for g in got][:3] == [1 / 8] * 3 and [g[2] for g in got][4:] == [1 / 4] * 2
    r = spectra.frequency_diffusion(out).first()
    assert r.n_windows == 6 and r.diffusion == pytest.approx(np.std(np.diff([g[2] for g in got])))
    assert math.isfinite(r.diffusion)


def test_an_object_is_drawn_once_a_replicate(spark):
    df = spark.createDataFrame([(o, k / 8, float(o + k)) for o in range(4) for k in range(1, 4)], "object long, frequency double, amplitude double")
    out = spectra.stacked_spectrum(df, 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # in the filter and in the column, not once a share that it is compared with
    assert 1 <= plan.count("md5(") <= 2
    assert plan.index("inline(points") < plan.index("md5(")
    rows = {r.frequency: r for r in out.collect()}
    assert {f: r.n_members for f, r in rows.items()} == {1 / 8: 4, 2 / 8: 4, 3 / 8: 4}
    assert spectra.stacked_spectrum(df.limit(0), 16).collect() == []
