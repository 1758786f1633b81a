"""Conversions of elements and shapes of distributions against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import orbital
from epochal.operators import density

NAN = float("nan")


def test_elements_and_states_go_round(spark):
    cases = [(7000.0, 0.1, 51.0, 20.0, 30.0, 40.0), (7000.0, 0.02, 151.0, 220.0, 330.0, 240.0), (42000.0, 0.7, 90.0, 0.0, 180.0, 359.0), (7000.0, 0.0, 30.0, 100.0, 0.0, 77.0), (7000.0, 0.2, 0.0, 0.0, 50.0, 60.0), (7000.0, 0.0, 0.0, 0.0, 0.0, 123.0), (7000.0, 0.1, 180.0, 0.0, 70.0, 20.0)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a double, e double, i double, o double, w double, v double")
    state = orbital.state_vector(*(F.col(c) for c in "aeiowv"))
    rows = df.select("k", *(state[c].alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    for r in orbital.with_elements(rows).collect():
        a, e, i, o, w, v = cases[r.k]
        assert (r.sma, r.ecc, r.inc) == (pytest.approx(a), pytest.approx(e, abs=1e-9), pytest.approx(i, abs=1e-5))
        assert r.h == pytest.approx(math.sqrt(orbital.MU * a * (1 - e * e))) and r.energy == pytest.approx(-orbital.MU / 2 / a)
        for got, want in ((r.raan, o), (r.aop, w), (r.nu, v)):
            assert (got - want + 180) % 360 - 180 == pytest.approx(0, abs=1e-5)
    line = spark.createDataFrame([(7000.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 1.0, 0.0, 0.0)], "x double, y double, z double, vx double, vy double, vz double")
    out = orbital.with_elements(line).collect()
    assert all(r.inc is None and r.nu is None for r in out)


def test_times(spark):
    r = spark.range(1).select(orbital.julian_date(F.lit(946_728_000_000_000)).alias("j"), orbital.sidereal_angle(F.lit(2451545.0)).alias("s")).first()
    assert (r.j, r.s) == (2451545.0, pytest.approx(100.4606184))
    df = spark.createDataFrame([(0.001,), (0.5,), (None,), (NAN,)], "e double").select(orbital.phase_choice(F.col("e"), F.lit("a"), F.lit("b")).alias("p"))
    assert [r.p for r in df.collect()] == ["b", "a", "a", "a"]


def test_densities(spark):
    rng = np.random.default_rng(2)
    own = {1: rng.normal(size=40), 2: rng.normal(size=3) * 9, None: rng.normal(size=5)}
    rows = [(o, float(x), float(10 * k % 360)) for o, v in own.items() for k, x in enumerate(v)] + [(3, 1.0, 1.0), (3, 2.0, 2.0), (4, 5.0, 1.0), (4, 5.0, 1.0), (4, 5.0, 2.0), (1, None, 3.0), (1, NAN, 3.0)]
    df = spark.createDataFrame(rows, "object long, value double, angle double")
    got = {}
    for r in density.kde(df, "value", 9).collect():
        got.setdefault(r.object, {})[r.point] = (r.x, r.density)
    assert set(got) == {1, 2, None}
    for o, v in own.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        for k, x in enumerate(np.linspace(v.min(), v.max(), 9)):
            assert got[o][k] == pytest.approx((x, np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))))
    known = np.array([(x, a) for _, x, a in rows if x is not None and not math.isnan(x)])
    v, a = known[:, 0], np.radians(known[:, 1])
    h = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    grid = {(r.i, r.j): r.density for r in density.circular_linear_kde(df, "angle", "value", 6, 5, 10.0).collect()}
    assert len(grid) == 30
    for i in range(6):
        for j, x in enumerate(np.linspace(v.min(), v.max(), 5)):
            want = (np.exp(10 * np.cos(2 * np.pi * i / 6 - a)) / (2 * np.pi * np.i0(10)) * np.exp(-0.5 * ((x - v) / h) ** 2) / (h * math.sqrt(2 * np.pi))).mean()
            assert grid[i, j] == pytest.approx(want)
    assert density.kde(df.limit(0), "value").collect() == [] and density.circular_linear_kde(df.limit(0), "angle", "value").collect() == []


def test_ellipses_and_features(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 2)) @ [[3, 1], [0, 1]]
    rows = [("a", *map(float, p), 1) for p in points] + [("b", 1.0, 1.0, 1), ("c", 1.0, 1.0, 1), ("c", 2.0, 1.0, 1), ("a", None, 1.0, 1), ("a", NAN, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, n int")
    got = {r.g: r for r in density.ellipses(df, "x", "y", "g").collect()}
    values, vectors = np.linalg.eigh(np.cov(points.T))
    assert set(got) == {"a", "c"} and (got["a"].width, got["a"].height) == pytest.approx((4 * math.sqrt(values[1]), 4 * math.sqrt(values[0])))
    turn = math.degrees(math.atan2(vectors[1, 1], vectors[0, 1])) - got["a"].angle
    assert abs((turn + 90) % 180 - 90) < 1e-6 and (got["c"].height, got["c"].angle) == (0.0, 0.0)
    some = spark.createDataFrame([(1.0, 90.0, None), (None, None, None), (NAN, 0.0, None), (4.0, NAN, None)], "a double, b double, c double")
    out = density.feature_columns(some, ["a", "c"], ["b"]).collect()
    assert [r.f_a for r in out] == [1.0, 2.5, 2.5, 4.0] and [r.f_c for r in out] == [0.0] * 4 and [round(r.f_sin_b, 9) for r in out] == [1.0, 0.5, 0.0, 0.5]
    assert density.feature_columns(some.limit(0), ["a"], []).collect() == []
