"""Even grids that stream by: one pass over the panel, the same results whatever the batches."""

import math

import pytest

from epochal.operators import spectra, wavelets

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(o, k * DAY + (o * 7919 * k) % DAY, k, math.sin(0.3 * k + o) + 0.01 * k, math.cos(0.3 * k) * (o + 1)) for o in range(3) for k in range(60 + 25 * o)]
    return spark.createDataFrame(rows, "object long, t long, rec long, a double, b double")



def results(panel):
    return {
        "dominant": spectra.dominant_frequencies(panel, 1.0, window=16, step=4, value="a"),
        "cross": spectra.cross_spectrum(panel, "a", "b", 1.0, segment=16),
        "lags": spectra.lag_correlations(panel, "a", "b", 1.0, 3),
        "wavelet": wavelets.cross_wavelet(panel, "a", "b", 1.0, [1.0, 2.0], chunk=32),
    }


@pytest.mark.parametrize("name", ["dominant", "cross", "lags", "wavelet"])
def test_one_grid_without_joins(panel, name):
    # points times bins or lags were rows of a hash table in a task, and the grid was made twice
    plan = results(panel)[name]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Generate explode(sequence") == 1


@pytest.mark.parametrize("name", ["dominant", "cross", "wavelet"])
def test_small_batches_change_nothing(spark, panel, name):
    keys = {"dominant": ["object", "s"], "cross": ["object", "frequency"], "wavelet": ["object", "scale", "i"]}[name]
    want = results(panel)[name].sort(*keys).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = results(panel)[name].sort(*keys).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert list(a) == pytest.approx(list(b), rel=1e-9, abs=1e-9)


def test_constant_series_has_no_coherence(spark):
    rows = spark.createDataFrame([(1, k * DAY, k, 0.1, float(k % 5)) for k in range(40)], "object long, t long, rec long, a double, b double")
    assert {r.coherence for r in spectra.cross_spectrum(rows, "a", "b", 1.0, segment=13).collect()} == {0.0}
