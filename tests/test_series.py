"""Window operators on hand-made series."""

import math

import pytest
from pyspark.sql import functions as F

from epochal.operators import asof, kernels, occupancy, quality, series
from epochal.sources.tables import DAY

SCHEMA = "object long, t long, value double, rec long"


def panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def values(df, column, order="rec"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_empty_panel(spark):
    empty = panel(spark, [])
    for f in (series.differences, series.derivative, series.central_slope, series.robust_z, series.cadence, kernels.detect_events, kernels.label_states):
        assert f(empty).count() == 0


def test_differences_and_derivative(spark):
    df = panel(spark, [(1, 0, 1.0, 1), (1, DAY, 3.0, 2), (1, DAY, 4.0, 3), (1, 3 * DAY, 8.0, 4), (2, 0, 5.0, 5)])
    out = series.differences(df)
    assert values(out, "d1") == [None, 2.0, 1.0, 4.0, None]
    assert values(out, "d2") == [None, None, -1.0, 3.0, None]
    assert values(series.derivative(df), "rate") == [2.0, 2.0, None, 2.0, None]


def test_centred_windows_of_odd_and_even_width(spark):
    df = panel(spark, [(1, i * DAY, float(v), i) for i, v in enumerate([5, 1, 9, 2, 7])])
    assert values(series.rolling_median(df, 3), "median") == [3.0, 5.0, 2.0, 7.0, 4.5]
    assert values(series.rolling_median(df, 4), "median") == [3.0, 5.0, 3.5, 4.5, 7.0]


def test_trailing_window_leaves_its_far_end_out(spark):
    df = panel(spark, [(1, 0, 1.0, 1), (1, 30 * DAY, 3.0, 2)])
    assert values(df.withColumn("n", F.count("*").over(series.trailing(30 * DAY))), "n") == [1, 1]


def test_bridges_only_short_inner_gaps(spark):
    mask = [0, 1, 0, 1, 0, 0, 0, 1, 0]
    df = panel(spark, [(1, i, float(v), i) for i, v in enumerate(mask)])
    assert values(series.bridged(df, F.col("value") > 0, 1), "mask") == [False, True, True, True, False, False, False, True, False]


def test_runs_take_null_as_a_state(spark):
    df = panel(spark, [(1, i, v, i) for i, v in enumerate([None, None, 1.0, 1.0, None])])
    assert values(series.runs(df, F.col("value")), "run") == [1, 1, 2, 2, 3]


def test_reasons_are_joined_and_null_rules_are_not_true(spark):
    df = panel(spark, [(1, 0, None, 1), (1, 0, -5.0, 2), (None, None, math.nan, 3)])
    rules = {"no_value": ~quality.finite(F.col("value")), "low": F.col("value") < 0, "no_time": F.col("t").isNull()}
    assert values(quality.reject_reasons(df, rules), "reasons") == ["no_value", "low", "no_value;no_time"]


@pytest.mark.parametrize(("tie", "want"), [("earlier", 0), ("later", 2 * DAY)])
def test_nearest_at_equal_distance(spark, tie, want):
    left = panel(spark, [(1, DAY, 0.0, 9)]).select("object", "t", "rec")
    right = panel(spark, [(1, 0, 1.0, 1), (1, 2 * DAY, 2.0, 2), (2, DAY, 3.0, 3)])
    assert values(asof.nearest(left, right, tie=tie), "near_t") == [want]
    assert values(asof.nearest(left, right, tolerance=DAY - 1, tie=tie), "near_t") == [None]


def test_interpolation_is_null_outside_and_exact_on_a_row(spark):
    left = panel(spark, [(1, t, 0.0, i) for i, t in enumerate([-1, 0, 5, 10, 11])]).select("object", "t", "rec")
    right = panel(spark, [(1, 0, 1.0, 1), (1, 10, 3.0, 2), (1, 10, 5.0, 3)])
    assert values(asof.interpolated(left, right), "interpolated_value") == [None, 1.0, 2.5, 4.0, None]


def test_interval_join_holds_both_ends(spark):
    points = panel(spark, [(1, t, 0.0, t) for t in (0, 1, 5, 9, 10)])
    spans = spark.createDataFrame([(1, 1, 9)], "object long, t_start long, t_end long")
    assert values(asof.in_intervals(points, spans, 4), "t", "t") == [1, 5, 9]


def test_cut_is_closed_on_the_right_and_keeps_outsiders(spark):
    df = panel(spark, [(1, 0, v, i) for i, v in enumerate([0.0, 10.0, 10.5, 99.0, None, math.nan])])
    assert values(df.withColumn("s", occupancy.cut(F.col("value"), (0.0, 10.0, 20.0))), "s") == ["(0.0, 10.0]", "(0.0, 10.0]", "(10.0, 20.0]", "nan", "nan", "nan"]


def test_greedy_matching_is_one_to_one(spark):
    df = spark.createDataFrame([(1, 10, "truth"), (1, 11, "truth"), (1, 12, "found"), (1, 90, "found")], "object long, t long, side string")
    got = {(r.t_truth, r.t_found, r.kind) for r in asof.greedy_matches(df, 5).collect()}
    assert got == {(10, 12, "tp"), (11, None, "fn"), (None, 90, "fp")}


def test_assignment_is_cheapest(spark):
    rng = __import__("random").Random(3)
    cost = {(i, j): rng.randint(0, 50) for i in range(4) for j in range(6)}
    df = spark.createDataFrame([(1, i, j, float(c)) for (i, j), c in cost.items()], "problem long, row long, col long, cost double")
    import itertools

    best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
    assert kernels.assignment(df).agg(F.sum("cost")).first()[0] == best


def test_spectrum_finds_a_tone(spark):
    rows = [(1, int(i * 0.25 * DAY), 3 * math.sin(2 * math.pi * 0.5 * i * 0.25), i) for i in range(160)]
    top = kernels.spectrum(panel(spark, rows), 0.25).orderBy(F.desc("amplitude")).first()
    assert abs(top.frequency - 0.5) < 0.03 and abs(top.amplitude - 3) < 0.3


def test_detected_step(spark):
    noise = __import__("random").Random(1)
    rows = [(1, i * DAY, noise.uniform(0, 0.3) + (50.0 if i >= 30 else 0.0), i) for i in range(60)]
    got = kernels.detect_events(panel(spark, rows)).collect()
    assert [r.t for r in got] == [30 * DAY]


def test_states_last(spark):
    rows = [(1, i * DAY, float(i), i) for i in range(5)]
    assert kernels.label_states(panel(spark, rows)).count() == 5


def test_spaced_keeps_the_ends(spark):
    df = panel(spark, [(1, t, 0.0, t) for t in (0, 1, 5, 6, 7)])
    assert values(kernels.spaced(df, 5), "t", "t") == [0, 5, 7]
