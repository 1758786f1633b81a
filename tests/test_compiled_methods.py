"""Generated code is compiled at run time only where its methods have at most 8,000 bytes; and the shorter forms tell the same as the longer ones."""

import contextlib
import io
import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from epochal.functions import orbital
from epochal.operators import quality, resonance

NAN = float("nan")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["resonance_screen", "resonance_widths", "elements_from_state"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    shown, before = io.StringIO(), spark.conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan has no code before it runs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(shown):
            __spark_entry__.queries()[name](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) <= 8000


def test_sound_elements_are_those_without_a_reason(spark):
    odd = [None, NAN, math.inf, -math.inf, -1.0, 0.0, 1.0, 180.0, 180.5, 9000.0, 9000.5]
    good = dict(ecc=0.1, inc=50.0, raan=1.0, aop=2.0, mean_anomaly=3.0, mean_motion=14.0, sma=7000.0)
    rows = [(5, *(good | {c: v}).values()) for c in good for v in odd] + [(None, *good.values())]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t long, " + ", ".join(f"{c} double" for c in good))
    want = {r.k for r in quality.reject_reasons(df, quality.element_rules(9000)).where("reasons = ''").collect()}
    assert {r.k for r in df.where(quality.sound_elements(9000)).collect()} == want
    assert 10 < len(want) < len(rows)


def test_behaviours_of_objects_in_one_pass(spark):
    day = 86_400_000_000
    rows = [(o, k * day // 3, k, 0.01, (7.0 * k * o) % 360 if k % 9 else None, 30.0 + 40 * math.sin(k) if k % 7 else NAN, (o * 1.5 * k) % 360) for o in (1, 2, 3) for k in range(60)]
    rows += [(None, k * day, k, 0.01, 1.0, 2.0, 3.0) for k in range(30)] + [(4, k * day, k, 0.01, None, 5.0, None) for k in range(30)] + [(5, 0, 0, 0.01, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "object long, t long, rec int, ecc double, raan double, aop double, mean_anomaly double").repartition(3)
    long = resonance.angle_behaviour(resonance.resonant_angles(df), ["object", "resonance"], ["t", "rec"]).select("object", "resonance", "behaviour")
    want = sorted(map(tuple, long.collect()), key=repr)
    assert sorted(map(tuple, resonance.object_behaviours(df).collect()), key=repr) == want
    assert len({w[2] for w in want}) > 2


def test_best_match_of_odd_rates(spark):
    some = (resonance.Resonance("a", "x", node=1), resonance.Resonance("b", "y", perigee=1), resonance.Resonance("c", "x", node=-1))
    df = spark.createDataFrame([(1, 0.5, 0.2, 1.0), (2, 0.2, 0.2, 1.0), (3, NAN, 0.3, 1.0), (4, None, None, 1.0), (5, NAN, NAN, NAN), (6, -0.0, 0.0, 1.0)], "k int, node double, perigee double, n double")
    got = {r.k: (r.name, r.family, r.proximity, r.near) for r in resonance.best_match(df, 0.25, some).collect()}
    assert got == {1: ("b", "y", 0.2, True), 2: ("a", "x", 0.2, True), 3: ("b", "y", 0.3, False), 4: (None, None, None, False), 5: (None, None, None, False), 6: ("a", "x", 0.0, True)}


def test_elements_of_odd_states(spark):
    rows = [(1, 7000.0, 0.0, 0.0, 0.0, 7.6, 0.0), (2, 7000.0, 0.0, 0.0, 0.0, -7.6, 0.0), (3, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (4, None, 0.0, 0.0, 0.0, 7.6, 0.0), (5, NAN, 0.0, 0.0, 0.0, 7.6, 1.0)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "k int, x double, y double, z double, vx double, vy double, vz double, h string")
    got = {r.k: r for r in orbital.with_elements(df).collect()}
    assert (got[1].inc, got[1].raan, got[1].aop in (0.0, 180.0)) == (0.0, 0.0, True) and got[2].inc == 180.0
    assert got[3].energy is None and got[3].sma is None and got[3].ecc is None and got[3].inc is None and got[3].h == 0.0
    assert all(got[4][c] is None for c in orbital.ELEMENTS.names) and math.isnan(got[5].h) and math.isnan(got[5].sma)
    assert orbital.with_elements(df.where(F.lit(False))).columns == [*df.columns, *(c for c in orbital.ELEMENTS.names if c != "h")]
