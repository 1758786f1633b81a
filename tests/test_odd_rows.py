"""Null objects, objects without values, single rows, equal times and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import kernels, sampling, vectors

DAY = 86_400_000_000
PANEL = "object long, t long, value double, rec long"
ODD = [(None, 0, 1.0, 1), (1, 0, None, 2), (1, DAY, None, 3), (2, 5, 4.0, 4), (3, 7, 1.0, 5), (3, 7, 2.0, 6), (3, 7, 2.5, 7)]
KERNELS = {
    "spectrum": lambda d: kernels.spectrum(d, 0.25),
    "welch": lambda d: kernels.welch(d, 0.25),
    "wavelet": lambda d: kernels.weighted_wavelet(d, [0.1, 0.5]),
    "ewm": lambda d: kernels.exponential_mean(d, 9),
    "events": kernels.detect_events,
    "states": kernels.label_states,
    "spaced": lambda d: kernels.spaced(d, DAY),
    "metropolis": kernels.metropolis,
    "periodogram": lambda d: kernels.periodogram(d, [0.1]),
}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_kernels_of_odd_rows(spark, name):
    for rows in (ODD, ODD[1:3], ODD[3:4], []):
        out = KERNELS[name](spark.createDataFrame(rows, PANEL)).collect()
        assert all(r.object in (None, 1, 2, 3) for r in out) and (rows or not out)


def test_exponential_mean_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(kernels, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(n % 2, n // 2 * DAY, None if rng.random() < 0.3 or n < 30 else rng.uniform(0, 9), n) for n in range(150)]
    got = {r.rec: r.ewm for r in kernels.exponential_mean(spark.createDataFrame(rows, PANEL), 40).collect()}
    for o in (0, 1):
        mean = None
        for _, _, v, rec in sorted(r for r in rows if r[0] == o):
            mean = mean if v is None else v if mean is None else mean + 2 / 41 * (v - mean)
            assert got[rec] == (mean if mean is None else pytest.approx(mean, rel=1e-12))


def test_distances_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(n, n % 3, rng.normal(size=2 + n % 2).tolist()) for n in range(20)] + [(20, 0, rows_0 := [0.5, 0.5]), (21, 0, rows_0), (22, 1, None), (23, 1, [1.0, None]), (24, 1, [math.nan, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    wide = {i: np.pad(v, (0, 3 - len(v))) for i, _, v in rows[:22]}
    for across in (True, False):
        got = {(r.id, r.other): (r.own, r.n, round(r.total, 9)) for r in vectors.distance_sums(df, across=across).collect()}
        want = {}
        for i, own, _ in rows[:22]:
            for c in range(3):
                others = [j for j, k, _ in rows[:22] if k == c and j != i]
                if c == own or across:
                    want[i, c] = (own, len(others), round(float(sum(np.linalg.norm(wide[i] - wide[j]) for j in others)), 9))
        assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in want)
    assert vectors.distance_sums(df.limit(0)).count() == 0


def test_stratified_sample_of_few_strata(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 5, None).when(F.col("id") < 2500, 1).otherwise(2).alias("s"), (F.col("id") * 7919 % sampling.SPREAD).alias("h"))
    got = sampling.stratified(df, "s", "h", "id", 0.1).collect()
    for s, low, high in ((None, 0, 5), (1, 5, 2500), (2, 2500, 3000)):
        first = sorted(range(low, high), key=lambda i: (i * 7919 % sampling.SPREAD, i))[: max(1, math.ceil((high - low) * 0.1))]
        assert {r.id for r in got if r.s == s} == set(first)
