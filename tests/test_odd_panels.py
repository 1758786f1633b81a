"""Rows of operators over null objects, null times, NaN, all-null objects, one row and empty tables."""

import math

import numpy as np
import pytest

from epochal.operators import coherence, kernels, phases, sampling

DAY = 86_400_000_000
NAN = float("nan")
PANEL = "object long, t long, value double, rec long"
GOOD = [(1, k * DAY, float(v), k) for k, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8])]
LOST = [(1, None, 7.0, 90), (1, 3 * DAY + 5, None, 91), (1, 4 * DAY + 5, NAN, 92)]
OTHERS = [(None, 0, 1.0, 100), (None, DAY, 3.0, 101), (2, 0, None, 102), (2, DAY, None, 103), (3, 5, 2.0, 104)]


def frame(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def test_leave_one_out(spark):
    got = {r.object: (r.n_others, r.total, r.total_known) for r in sampling.leave_one_out(frame(spark, GOOD + LOST[1:] + OTHERS), {"total": "value"}).collect()}
    assert got == {1: (5, 6.0, 3), 2: (17, 58.0, 15), 3: (18, 56.0, 14), None: (17, 54.0, 13)}
    alone = sampling.leave_one_out(frame(spark, GOOD), {"total": "value"}).first()
    assert (alone.n_others, alone.total, alone.total_known) == (0, None, 0)
    assert sampling.leave_one_out(frame(spark, []), {"total": "value"}).collect() == []


def test_first_seen_over_ranges(spark):
    rows = [(k, k * 7919 % 1000, 0.0, k * 31 % 997) for k in range(997)]
    got = sampling.first_seen(frame(spark, [*rows, (None, 0, 0.0, 5000)]), "object", "rec").collect()
    assert sorted(got, key=lambda r: r.position) == sorted(got, key=lambda r: r.first) and {r.position for r in got} == set(range(998))
    assert sampling.first_seen(frame(spark, []), "object", "rec").collect() == []


def test_lines_and_modes_keep_rows_without_an_object(spark):
    rows = frame(spark, GOOD + LOST + OTHERS)
    n = len(GOOD + LOST + OTHERS)
    out = {r.rec: r.residual for r in coherence.line_residuals(rows).collect()}
    x, y = np.array([r[1] / DAY for r in GOOD]), np.array([r[2] for r in GOOD])
    fit = np.polyfit(x, y, 1)
    assert len(out) == n and [out[k] for k in range(12)] == pytest.approx(list(y - np.polyval(fit, x)))
    assert all(out[k] is None for k in (91, 92, 100, 101, 102, 104))
    scored = {r.rec: r.y for r in coherence.normalised(rows, "zscored").collect()}
    values = np.array([*y, 7.0])
    assert len(scored) == n and [scored[k] for k in range(12)] == pytest.approx(list((y - values.mean()) / values.std()))
    assert scored[91] is None and scored[92] is None and (scored[100], scored[101]) == (-1.0, 1.0) and scored[102] is None and scored[104] == 0.0
    lines = {r.rec: r.y for r in coherence.normalised(rows, "detrended").collect()}
    assert len(lines) == n and lines[100] == pytest.approx(0) and lines[91] is None and lines[92] is None
    assert coherence.normalised(rows.limit(0), "detrended").collect() == [] and coherence.line_residuals(rows.limit(0)).collect() == []


def test_wavelets_drop_rows_without_time_or_value(spark):
    key = lambda d: sorted((r.object, round(r.tau_days, 9), r.frequency, round(r.z, 6)) for r in d.collect())
    both = key(kernels.weighted_wavelet(frame(spark, GOOD + LOST + OTHERS), [0.1, 0.25]))
    assert both == key(kernels.weighted_wavelet(frame(spark, GOOD), [0.1, 0.25])) and {r[0] for r in both} == {1}
    x, y = np.array([r[1] / DAY for r in GOOD]), np.array([r[2] for r in GOOD])
    want = []
    for tau in np.linspace(0, x[-1], 8):
        for f in (0.1, 0.25):
            a = 2 * np.pi * f * (x - tau)
            w = np.exp(-0.0125 * a * a)
            n = w.sum() ** 2 / (w * w).sum()
            if n > 3.5:
                design = np.stack([np.ones_like(x), np.cos(a), np.sin(a)], 1)
                fit = design @ np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
                spread = lambda v, w=w: (w * v * v).sum() / w.sum() - ((w * v).sum() / w.sum()) ** 2
                want.append((1, round(tau, 9), f, (n - 3) * spread(fit) / (2 * (spread(y) - spread(fit)))))
    assert [b[:3] for b in both] == [w[:3] for w in sorted(want)]
    assert [b[3] for b in both] == pytest.approx([w[3] for w in sorted(want)], rel=1e-5)
    assert kernels.weighted_wavelet(frame(spark, []), [0.1]).collect() == []


def test_exponential_means_take_nan_as_null(spark):
    rows = [(1, k, v, k) for k, v in enumerate([None, 2.0, NAN, 4.0, None])] + [(None, 0, 1.0, 9)]
    got = {r.rec: r.ewm for r in kernels.exponential_mean(frame(spark, rows), 3).collect()}
    assert got == {0: None, 1: 2.0, 2: 2.0, 3: 3.0, 4: 3.0}
    two = kernels.exponential_means(frame(spark, rows), 3, {"value": "a", "rec": "b"})
    both = {r.rec: (r.a, r.b) for r in two.collect()}
    assert both[3] == (3.0, 2.125) and both[0] == (None, 0.0)


def test_phases_of_odd_objects_and_overrides(spark):
    rows = [(1, 5 * k * DAY, k, 0.0, 1.0, 0.0) for k in range(40)]
    rows[10] = (1, 50 * DAY, 10, -0.3, 1.0, 5e-4)  # descent with drag
    rows[20] = (1, 100 * DAY, 20, 0.7, 1.0, 0.0)  # steep ascent
    rows[30] = (1, 150 * DAY, 30, 0.3, 1.0, 0.0)  # ascent that an event backs
    odd = [(None, 0, 0, 0.0, 1.0, 0.0), *((2, k * DAY, k, 5.0, None, NAN) for k in range(9)), *((3, k * DAY, k, None, NAN, None) for k in range(12))]
    df = spark.createDataFrame(rows + odd, "object long, t long, rec long, slope double, variation double, drag double")
    df = df.selectExpr("*", "CASE WHEN rec = 30 THEN 0.1 ELSE 0.0 END AS event_rate", "1.0D AS upkeep_regularity")
    got = {(r.object, r.rec): r for r in phases.mission_phases(df).collect()}
    assert len(got) == 40 + 9 + 12
    assert got[1, 10].state == "disposal_lowering" and got[1, 10].score >= 0.85 and got[1, 10].confidence >= 0.7
    assert got[1, 20].state == got[1, 30].state == "insertion_or_orbit_raise" and got[1, 20].score >= 0.65
    assert {r.state for k, r in got.items() if k[0] == 1 and k[1] not in (10, 20, 30)} == {"operational_shell"}
    assert got[1, 5].rationale == "stable_altitude_and_regular_maintenance" and 0 < got[1, 5].confidence < 1
    assert all((r.state, r.score, r.confidence, r.rationale) == ("unknown", 0.0, 0.0, "insufficient_history") for k, r in got.items() if k[0] == 2)
    assert all(math.isfinite(r.score) and r.state in phases.STATES for r in got.values())
    assert phases.mission_phases(df.limit(0)).collect() == []


def test_relocation_counts_as_operational(spark):
    rows = [(1, k * 5 * DAY, k, 0.0, 1.0, 60.0) for k in range(20)]
    df = spark.createDataFrame(rows, "object long, t long, rec long, slope double, variation double, shell_residual double")
    assert {r.state for r in phases.label(df).collect()} == {"relocation"}
    out = phases.mission_phases(df).collect()
    assert {r.state for r in out} == {"operational_shell"} and all(r.score >= 0.65 and r.confidence >= 0.5 for r in out)
