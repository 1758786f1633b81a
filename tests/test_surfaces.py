"""Wavelet stacks and cross wavelets, seams, segments and arcs against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import density, models, quality, wavelets

NAN = float("nan")


def test_stacks_lie_on_lines_between_times(spark):
    own = {1: {0.0: 1.0, 2.0: 3.0, 4.0: NAN, 6.0: 7.0}, 2: {1.0: 10.0, 3.0: 20.0}, 3: {2.0: 5.0}}
    rows = [(o, t, f, z * f) for o, v in own.items() for t, z in v.items() for f in (0.5, 1.0)] + [(None, 0.0, 0.5, 1.0), (4, None, 0.5, 1.0), (4, 0.0, None, 1.0), (4, 0.0, 0.5, None), (3, 2.0, 0.5, 2.5)]
    df = spark.createDataFrame(rows, "object long, tau_days double, frequency double, z double")
    grid = [0.0, 1.0, 2.0, 3.0, 5.0, 6.0, 9.0]
    got = {(r.tau_days, r.frequency): (r.power, r.n_objects) for r in wavelets.stacked(df, grid).collect()}
    want = {}
    for t in grid:
        for f in (0.5, 1.0):
            values = []
            for v in own.values():
                known = {a: z for a, z in v.items() if not math.isnan(z)}
                if min(known) <= t <= max(known):
                    values.append(f * float(np.interp(t, list(known), list(known.values()))))
            if values:
                want[t, f] = (pytest.approx(np.mean(values)), len(values))
    assert got == want and (9.0, 0.5) not in got
    assert wavelets.stacked(df.limit(0), grid).count() == 0 and wavelets.marked(wavelets.stacked(df.limit(0), grid)).count() == 0


def test_ridges_cones_and_peaks(spark):
    rng = np.random.default_rng(1)
    power, freq = rng.normal(size=(9, 5)).round(1), [0.05, 0.2, 0.5, 1.0, 4.0]
    rows = [(i, float(i), f, float(power[i, j])) for i in range(9) for j, f in enumerate(freq)]
    df = spark.createDataFrame(rows, "i int, tau_days double, frequency double, power double")
    assert {r.i: r.frequency for r in wavelets.ridge(df).collect()} == {i: freq[int(power[i].argmax())] for i in range(9)}
    for r in wavelets.marked(df).collect():
        j = freq.index(r.frequency)
        around = power[max(0, r.i - 1) : r.i + 2, max(0, j - 1) : j + 2]
        assert r.peak == (power[r.i, j] >= around.max()) and r.inside == (0.5 / r.frequency <= r.i <= 8 - 0.5 / r.frequency)


def plain_cross(x, y, scales):
    """Whole transforms, one sum a point and scale, and smoothing by loops over mirrored places."""
    n, out = len(x), []
    for v in (x, y):
        t = np.arange(n)
        rows = []
        for s in scales:
            k = (t[None, :] - t[:, None]) / s
            psi = np.exp(2j * math.pi * k - k * k / 1.5) / math.sqrt(1.5 * math.pi * s)
            psi[np.abs(t[None, :] - t[:, None]) > math.ceil(8 * s)] = 0
            rows.append((v[None, :] * psi.conj()).sum(1))
        out.append(np.array(rows))

    def mirror(a, m):
        while not 0 <= a < m:
            a = -a - 1 if a < 0 else 2 * m - 1 - a
        return a

    def smooth(z):
        for axis, sigma in ((0, 1.0), (1, 1.5)):
            reach = int(4 * sigma + 0.5)
            w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            m = z.shape[axis]
            z = sum(c * np.take(z, [mirror(a + d, m) for a in range(m)], axis) for c, d in zip(w / w.sum(), range(-reach, reach + 1), strict=True))
        return z

    cross = out[0] * out[1].conj()
    whole = smooth(np.abs(out[0]) ** 2) * smooth(np.abs(out[1]) ** 2)
    safe = np.where(whole > 1e-300, whole, 1.0)
    return np.abs(cross), np.angle(cross), np.where(whole > 1e-300, np.clip(np.abs(smooth(cross)) ** 2 / safe, 0, 1), 0)


@pytest.mark.parametrize("chunk", [5, 32, 4096])
def test_cross_wavelets_by_chunks(spark, chunk):
    rng = np.random.default_rng(2)
    series = {1: 70, 2: 16, 3: 15, 4: 33}
    rows = [(o, k * 43_200_000_000, k, float(np.sin(k / 3) + rng.normal()), float(np.cos(k / 3) + rng.normal()) if o != 4 else 0.0) for o, n in series.items() for k in range(n)]
    rows += [(None, 0, 0, 1.0, 1.0), (1, None, 0, 1.0, 1.0), (1, 43_200_000_000 * 3 + 7, 0, NAN, 1.0), (1, 43_200_000_000 * 3 + 9, 0, 1.0, None), (1, 0, 500, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "object long, t long, rec long, x double, y double").repartition(3)
    scales = [1.0, 2.0, 3.5]
    got = {}
    for r in wavelets.cross_wavelet(df, "x", "y", 0.5, scales, chunk=chunk).collect():
        got.setdefault(r.object, {})[r.scale, r.i] = (r.power, r.phase, r.coherence, r.frequency)
    assert set(got) == {1, 2, 4}
    for o in got:
        own = [r for r in rows if r[0] == o and r[1] is not None and r[1] % 43_200_000_000 == 0 and r[2] != 500]
        power, phase, coherence = plain_cross(np.array([r[3] for r in own]), np.array([r[4] for r in own]), scales)
        assert len(got[o]) == power.size
        for (s, i), (p, a, c, f) in got[o].items():
            k = scales.index(s)
            assert p == pytest.approx(power[k, i], abs=1e-9) and c == pytest.approx(coherence[k, i], abs=1e-7) and f == 1 / (s * 0.5)
            assert p < 1e-9 or abs((a - phase[k, i] + math.pi) % (2 * math.pi) - math.pi) < 1e-6
    with pytest.raises(ValueError, match="scales"):
        wavelets.cross_wavelet(df, "x", "y", 0.5, [2.0, 1.0])
    assert wavelets.cross_wavelet(df.limit(0), "x", "y", 0.5, scales).count() == 0


def test_a_long_series_is_spread(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("object"), (F.col("id") * 86_400_000_000).alias("t"), F.col("id").alias("rec"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    out = wavelets.cross_wavelet(df, "x", "y", 1.0, [2.0, 4.0], chunk=512)
    whole = out.groupBy("scale").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert {tuple(r) for r in whole} == {(2.0, 3000, 3000, 0, 2999), (4.0, 3000, 3000, 0, 2999)}


def test_seams(spark):
    df = spark.createDataFrame([(1, 5.0, 355.0), (2, 180.0, 0.0), (3, 365.0, 100.0), (4, None, 1.0), (5, -1.0, NAN), (6, 10.0, 350.0)], "k int, x double, y double")
    got = Counter((r.k, r.x, r.y, r.copied) for r in density.seam_copies(df.where("k <> 5"), "x", "y").collect())
    assert got == Counter([(1, 5.0, 355.0, False), (1, 365.0, 355.0, True), (1, 5.0, -5.0, True), (1, 365.0, -5.0, True), (2, 180.0, 0.0, False), (2, 180.0, 360.0, True), (3, 5.0, 100.0, False), (3, 365.0, 100.0, True), (4, None, 1.0, False), (4, None, 361.0, True), (6, 10.0, 350.0, False), (6, 370.0, 350.0, True), (6, 10.0, -10.0, True), (6, 370.0, -10.0, True)])
    assert {r.x for r in density.seam_copies(df.where("k = 2"), "x", "y", half=True).collect()} == {-180.0, 180.0}


@pytest.mark.parametrize(("ci", "cj"), [(True, True), (True, False), (False, True), (False, False)])
@pytest.mark.parametrize("pad", [0, 1, 2])
def test_padding(spark, pad, ci, cj):
    grid = np.arange(1, 16).reshape(5, 3)
    df = spark.createDataFrame([(i, j, int(grid[i, j])) for i in range(5) for j in range(3)] + [(9, 0, 5), (None, 0, 5)], "i int, j int, n long")
    want = np.pad(np.pad(grid, ((pad, pad), (0, 0)), mode="wrap" if ci else "edge"), ((0, 0), (pad, pad)), mode="wrap" if cj else "edge")
    rows = density.padded(df, 5, 3, pad, ci, cj).collect()
    assert len(rows) == want.size and all(r.n == want[r.i + pad, r.j + pad] for r in rows)
    with pytest.raises(ValueError, match="pad"):
        density.padded(df, 5, 3, 4)


def test_segments_for_fits(spark):
    rows = [(1, 1.0, 1.0, 2.0, 1.0), (2, NAN, 1.0, 2.0, 1.0), (3, None, 1.0, 2.0, 1.0), (4, 1.0, NAN, 2.0, 1.0), (5, 1.0, 1.0, 2.0, 0.5), (6, 1.0, 1.0, 2.0, None), (7, 1.0, 1.0, math.inf, 1.0)]
    df = spark.createDataFrame(rows, "k int, core double, a double, b double, m double")
    got = {r.k: (r.m, r.a, r.b) for r in quality.sanitised(df, ["core"], {"m": ["a", "b"]}).collect()}
    assert got == {1: (1.0, 1.0, 2.0), 4: (0.0, 0.0, 0.0), 5: (0.5, 0.0, 0.0), 6: (0.0, 0.0, 0.0), 7: (0.0, 0.0, 0.0)}
    assert {r.k: r.new for r in quality.sanitised(df, [], {"new": ["a"]}).collect()} == {k: float(k != 4) for k in range(1, 8)}


def test_errors_of_arcs(spark):
    rows = [("p", "x", 1, 1.0, 2.0, 350.0, 10.0), ("p", "x", 2, 1.0, 4.0, 10.0, 350.0), ("p", "y", 1, 5.0, 5.0, 0.0, None), ("q", "z", 1, 1.0, 1.5, 0.0, 180.0), ("q", "w", 1, None, 1.0, 0.0, 0.0), ("q", "v", 1, NAN, 1.0, 0.0, 0.0), (None, "u", 1, 0.0, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "phase string, arc string, k int, seen double, told double, a double, b double")
    arcs = models.arc_errors(df, "arc", "seen", "told", ["k"], {"node": ("a", "b")}, keep=("phase",))
    assert {r.arc: (r.phase, r.n_obs, r.path_rmse, r.node_error) for r in arcs.collect()} == {"x": ("p", 2, pytest.approx(math.sqrt(5)), 20.0), "y": ("p", 1, 0.0, None), "z": ("q", 1, 0.5, 180.0), "u": (None, 1, 3.0, 0.0)}
    got = {(r.phase, r.whole): (r.n_arcs, round(r.rmse_mean, 6), r.rmse_median, r.node_mae) for r in models.error_report(arcs, "phase", ["node"]).collect()}
    half = math.sqrt(5) / 2
    assert got[("p", False)] == (2, round(half, 6), pytest.approx(half), 20.0) and got[(None, False)] == (1, 3.0, 3.0, 0.0) and got[(None, True)][0] == 4


def test_quantiles_of_errors_without_all_errors_in_one_task(spark, monkeypatch):
    """Cuts around a quantile leave exact results: ties, one value only, infinities, nulls, a null phase; no state of all of a phase's errors."""
    monkeypatch.setattr(models, "UNCUT", 1500, raising=False)
    rng = random.Random(3)
    own = {"a": [rng.lognormvariate(0, 2) for _ in range(4000)], "b": [float(rng.randint(0, 3)) for _ in range(3001)], "c": [7.0] * 2000, None: [rng.random() for _ in range(3)], "e": [1.0, math.inf], "f": [2.5], "g": [None]}
    rows = [(p, x, 1.0) for p, xs in own.items() for x in xs]
    rng.shuffle(rows)
    arcs = spark.createDataFrame(rows, "phase string, path_rmse double, node_error double").repartition(3)
    out = models.error_report(arcs, "phase", ["node"])
    assert " percentile(" not in out._jdf.queryExecution().toString().replace(",", " ").replace("[", " ")
    got = {(r.phase, r.whole): (r.n_arcs, r.rmse_median, r.rmse_p90) for r in out.collect()}
    p = lambda q: F.percentile("path_rmse", F.lit(q))
    want = arcs.rollup("phase").agg((F.grouping("phase") == 1).alias("whole"), F.count("*").alias("n"), p(0.5).alias("m"), p(0.9).alias("t")).collect()
    assert got == {(r.phase, r.whole): (r.n, r.m, r.t) for r in want} and len(got) == 8
