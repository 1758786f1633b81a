"""Resonance screening and widths, outer rates, members and policies against plain versions."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochal.functions import orbital
from epochal.operators import policies, resonance

NAN = float("nan")


def test_capture_needs_proximity_and_libration(spark):
    names = ["inc_domega_zero", "tesseral_15_1"]
    rows = [(1, 0.5, names[0], True), (1, 1e-4, names[0], True), (1, 0.5, names[1], True), (1, 1e-4, names[1], True), (1, 0.5, names[0], False), (2, 0.5, names[0], True), (None, 0.5, names[0], True), (1, 0.5, None, False), (3, NAN, names[0], True), (3, None, names[0], True)]
    matches = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "k int, object long, ecc double, name string, near boolean, behaviour string")
    behaviours = spark.createDataFrame([(1, names[0], "libration_candidate"), (1, names[1], "libration_candidate"), (2, names[0], "circulation"), (None, names[0], "libration_candidate"), (3, names[0], "libration_candidate"), (3, names[0], "libration_candidate")], "object long, resonance string, behaviour string")
    got = {r.k: r for r in resonance.screened(matches, behaviours).collect()}
    assert len(got) == len(rows)
    weak, full, no = "low_confidence_low_e_apsidal", "screening_candidate", "not_candidate"
    assert [got[k].confidence for k in range(10)] == [full, weak, full, full, no, no, no, no, full, full]
    assert [got[k].behaviour for k in (5, 6, 7)] == ["circulation", "insufficient_data", "insufficient_data"]
    assert resonance.screened(matches, behaviours.limit(0)).where("candidate").count() == 0


def plain_local(residuals, scale, window):
    r = pd.Series(residuals, dtype=float).abs()
    mid = r.rolling(max(3, window), min_periods=3).median().to_numpy()
    slope = np.abs(np.gradient(mid))
    return scale / (1 + np.where(np.isfinite(mid), mid, r) + slope)


@pytest.mark.parametrize("window", [2, 5, 12])
def test_widths(spark, window):
    rng = np.random.default_rng(4)
    own = {1: [float(x) for x in rng.exponential(size=30)], 2: [float(x) for x in rng.exponential(size=4)], 3: [0.1, 0.2], 4: [0.3]}
    own[1][12] = own[1][20] = NAN
    rows = [(o, t, x, "TESSERAL_GROUNDTRACK" if o == 1 else None) for o, v in own.items() for t, x in enumerate(v)] + [(9, 0, None, "none")]
    df = spark.createDataFrame([(o, t, t, x, f) for o, t, x, f in rows], "object long, t long, rec long, proximity double, family string").repartition(3)
    local = {(r.object, r.t): r for r in resonance.width_proxy(df, "rolling_local", window).collect()}
    for o, scale in ((1, 0.6), (2, 0.5), (3, 0.5)):
        for t, want in enumerate(plain_local(own[o], scale, window)):
            r = local[o, t]
            assert (r.width, r.width_confidence) == ((None, None) if math.isnan(want) else (pytest.approx(want), 0.75))
    assert local[4, 0].width is None and local[9, 0].width is None and len(local) == len(rows)
    plain = {(r.object, r.t): (r.width, r.width_confidence) for r in resonance.width_proxy(df, "reciprocal").collect()}
    scaled = {(r.object, r.t): (r.width, r.width_confidence) for r in resonance.width_proxy(df).collect()}
    assert plain[3, 0] == (pytest.approx(1 / 1.1), 0.4) and scaled[1, 0] == (pytest.approx(0.6 / (1 + own[1][0])), 0.6) and scaled[1, 12] == plain[9, 0] == (None, None)
    assert resonance.width_proxy(df.limit(0), "rolling_local").count() == 0
    with pytest.raises(ValueError, match="method"):
        resonance.width_proxy(df, "other")


def test_outer_rates(spark):
    rows = [(7000.0, 0.01, 30.0), (26560.0, 0.7, 63.4), (7000.0, 1.0, 30.0), (7000.0, -0.1, 30.0), (0.0, 0.1, 30.0), (NAN, 0.1, 30.0), (7000.0, NAN, 30.0), (7000.0, 0.1, NAN), (None, 0.1, 30.0)]
    node, perigee = orbital.third_body_rates(F.col("a"), F.col("e"), F.col("i"))
    got = spark.createDataFrame(rows, "a double, e double, i double").select(node.alias("n"), perigee.alias("p")).collect()
    for r, (a, _, i) in zip(got[:2], rows, strict=False):
        n = math.sqrt(398600.4418 / a**3)
        pull = 1.32712440018e11 / 398600.4418 * (a / 149597870.7) ** 3 / (1 - 0.0167086**2) ** 1.5 + 4902.800066 / 398600.4418 * (a / 384400) ** 3 / (1 - 0.0549**2) ** 1.5
        c = math.cos(math.radians(i))
        assert (r.n, r.p) == pytest.approx((-0.75 * n * pull * c, 0.75 * n * pull * (5 * c * c - 1)))
    assert all(r.n is None and r.p is None for r in got[2:])


def test_votes(spark):
    rows = [("a", "1"), ("a", "2"), ("a", "2"), ("b", "3"), ("b", "1"), ("c", "x"), ("c", None), ("c", "4"), (None, "1"), ("d", "2.0")]
    got = {r.object: (r.cluster_id, r.votes, r.n_rows) for r in policies.voted(spark.createDataFrame(rows, "object string, cluster_id string")).collect()}
    assert got == {"a": (2, 2, 3), "b": (1, 1, 2), "c": (0, 2, 3), "d": (2, 1, 1)}
    some = spark.createDataFrame([("a", 9, 1), ("z", 9, 2), (None, 9, 3)], "object string, cluster_id int, k int")
    out = policies.assigned(some, policies.voted(spark.createDataFrame(rows, "object string, cluster_id string"))).collect()
    assert {r.k: r.cluster_id for r in out} == {1: 2, 2: 0, 3: 0}


def test_pooled_members(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(c), float(rng.normal(7000, 50)), float(rng.uniform(0, 360)), 1.0) for k, c in enumerate(rng.integers(-1, 4, size=80))]
    rows += [(200, 7, 7000.0, 10.0, 1.0), (300, 8, 7000.0, 10.0, 1.0), (299, 8, 7000.0, 10.0, 1.0), (400, None, 1.0, 1.0, 1.0), (401, 9, None, NAN, 1.0)]
    df = spark.createDataFrame(rows, "object long, cluster_id long, a double, w double, same double")
    sizes = spark.createDataFrame([(1, 500), (8, 2), (0, 77)], "cluster_id long, count long")
    got = policies.pooled(df, ["a", "same"], ["w"], sizes=sizes).collect()
    known = [r for r in rows if r[1] is not None and r[1] > 0]
    x = np.array([[NAN if a is None else a, s, math.sin(math.radians(w)), math.cos(math.radians(w))] for _, _, a, w, s in known])
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    label = np.array([r[1] for r in known])
    want = {}
    for c in set(label.tolist()):
        own = [(round(float(((z[k] - z[label == c].mean(0)) ** 2).sum()), 9), known[k][0]) for k in np.flatnonzero(label == c)]
        want[c] = (min(own)[1], len(own), {1: 500, 8: 2}.get(c, len(own)))
    assert {r.cluster_id: (r.object, r.weight_active, r.weight_global) for r in got if r.role == "medoid"} == want and want[8][0] == 299
    noise = {r.object: (r.weight_active, r.weight_global) for r in got if r.role == "noise"}
    assert noise == {r[0]: (1, 77 if r[1] == 0 else 1) for r in rows if r[1] is None or r[1] <= 0}
    assert policies.pooled(df.limit(0), ["a"], []).count() == 0


def test_policies_of_members(spark):
    rows = [(1, 1, 7000.0, 350.0, 5.0), (2, 2, 6490.0, 10.0, None), (3, 0, 7000.0, 1.0, 1.0), (4, None, None, 1.0, 1.0), (5, 9, 7000.0, 361.0, -1.0)]
    df = spark.createDataFrame(rows, "object long, cluster_id long, sma double, raan double, mean_anomaly double")
    given = spark.createDataFrame([(1, 5.0, math.radians(20), NAN), (2, -3.0, None, math.inf), (0, 9.0, 1.0, 1.0), (None, 9.0, 1.0, 1.0)], "cluster_id long, delta_a double, delta_Omega double, delta_lambda double")
    got = {r.object: r for r in policies.offset(policies.with_policy(df, given)).collect()}
    assert [got[k].policy_applied for k in range(1, 6)] == [True, True, False, False, False]
    assert (got[1].sma, got[1].mean_anomaly) == (7005.0, 5.0) and got[1].raan == pytest.approx(10.0)
    assert (got[2].sma, got[2].raan, got[2].mean_anomaly) == (pytest.approx(policies.LEAST_SMA), 10.0, None)
    assert got[4].sma is None and (got[5].raan, got[5].mean_anomaly) == (1.0, 359.0) and got[3].policy_tau_keep == 86400.0
    assert policies.with_policy(df, given.limit(0)).where("policy_applied").count() == 0


def test_bounds(spark):
    nominal = dict(policies.NOMINAL)
    cases = [({}, ""), ({"delta_a": 11.0, "tau_keep": 1.0}, "delta_a outside [-10.0, 10.0]"), ({"tau_keep": 1.0}, "tau_keep outside [3600.0, 604800.0]"), ({"delta_lambda": None}, "delta_lambda unknown"), ({"deadband_a": NAN}, "deadband_a unknown"), ({"delta_a": -10.0}, "orbit below the least safe altitude"), ({"delta_a": -1.0, "reserve_prop_frac": 0.4}, "")]
    df = spark.createDataFrame([(k, *({**nominal, **c}[f] for f in policies.FIELDS)) for k, (c, _) in enumerate(cases)], "k int, " + ", ".join(f"{f} double" for f in policies.FIELDS))
    assert [r.reason for r in df.withColumn("reason", policies.infeasible(sma=6500.0)).orderBy("k").collect()] == [w for _, w in cases]
    loose = {**policies.BOUNDS, "reserve_prop_frac": (0.0, 2.0)}
    df = df.withColumn("reserve_prop_frac", F.lit(1.5)).where("k = 0")
    assert df.select(policies.infeasible(loose).alias("r")).first().r == "reserve_prop_frac too high"


def test_ranking(spark):
    def trial(c, cost, reason="", **own):
        return (c, cost, reason, *({**policies.NOMINAL, **own}[f] for f in policies.FIELDS))

    rows = [trial(1, 3.0), trial(1, 2.0), trial(1, 2.0, delta_a=-1.0), trial(1, 1.0, "bad", delta_a=2.0), trial(1, None, delta_a=3.0), trial(1, NAN, delta_a=4.0), trial(1, 9.0, None, delta_a=5.0), trial(2, 4.0, delta_a=1.0)]
    df = spark.createDataFrame(rows, "cluster_id long, cost double, reason string, " + ", ".join(f"{f} double" for f in policies.FIELDS))
    got = Counter((r.cluster_id, r["rank"], r.delta_a, r.cost, r.n_trials, r.nominal) for r in policies.ranked(df, 2).collect())
    assert got == Counter([(1, 1, 0.0, 2.0, 2, True), (1, 2, -1.0, 2.0, 1, False), (2, 1, 1.0, 4.0, 1, False)])
    assert policies.ranked(df, 5).where("cluster_id = 1").count() == 3 and policies.ranked(df.limit(0), 2).count() == 0


def test_comparison(spark):
    base = spark.createDataFrame([(1, 10.0, 350.0, "x"), (2, 5.0, 0.0, "x"), (3, None, 1.0, "x")], "id int, a double, w double, delta_a string")
    other = spark.createDataFrame([(1, 12.5, 5.0), (3, 1.0, None), (4, 1.0, 1.0)], "id int, a double, w double")
    got = {r.id: (r.base_a, r.other_a, r.delta_a, r.delta_w) for r in policies.compared(base, other, "id", ["a"], ["w"]).collect()}
    assert got == {1: (10.0, 12.5, 2.5, 15.0), 2: (5.0, None, None, None), 3: (None, 1.0, None, None), 4: (None, 1.0, None, None)}


def test_half_turns_differ_as_in_sql(spark):
    import math

    pairs = [(k, k / 10.0, (k + 1800) % 3600 / 10.0) for k in range(3600)]
    df = spark.createDataFrame(pairs, "object long, a double, b double")
    out = policies.compared(df.select("object", F.col("a").alias("raan")), df.select("object", F.col("b").alias("raan")), "object", [], ["raan"])
    want = {k: b - a + 180 - 360 * math.floor((b - a + 180) / 360) - 180 for k, a, b in pairs}
    assert {r["object"]: r["delta_raan"] for r in out.collect()} == want
