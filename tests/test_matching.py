"""Greedy matches and spaced rows, cut at gaps, against plain loops over random panels."""

import random

import pytest
from pyspark.sql import functions as F

from epochal.operators import asof, kernels


def plain_matches(rows, tolerance):
    out = []
    for o in {r[0] for r in rows}:
        truth = sorted(t for p, t, s in rows if p == o and s == "truth" and t is not None)
        free = sorted(t for p, t, s in rows if p == o and s == "found" and t is not None)
        for t in truth:
            best = min(free, key=lambda f: (abs(f - t), f), default=None)
            if best is not None and abs(best - t) <= tolerance:
                free.remove(best)
                out.append((o, t, best, "tp"))
            else:
                out.append((o, t, None, "fn"))
        out += [(o, None, f, "fp") for f in free]
    return sorted(out, key=repr)


def events(rng, n, span):
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(span), rng.choice(["truth", "found"])) for _ in range(n)]
    return [*rows, (1, None, "truth"), (4, 7, "found"), (5, 7, "truth")]


@pytest.mark.parametrize(("span", "tolerance"), [(50, 3), (400, 3), (400, 20), (4000, 5), (400, 0)])
def test_matches(spark, span, tolerance):
    rng = random.Random(span + tolerance)
    rows = events(rng, 300, span)
    df = spark.createDataFrame([*rows, (1, 3, "other"), (1, 3, None)], "object long, t long, side string").repartition(3)
    got = sorted((tuple(r) for r in asof.greedy_matches(df, tolerance).collect()), key=repr)
    assert got == plain_matches(rows, tolerance)
    assert asof.greedy_matches(df.limit(0), tolerance).count() == 0


def test_a_long_dense_piece_is_fast(spark):
    df = spark.range(60_000).select(F.lit(1).cast("long").alias("object"), F.col("id").alias("t"), F.when(F.col("id") % 2 == 0, "truth").otherwise("found").alias("side"))
    assert {r.kind: r["count"] for r in asof.greedy_matches(df, 5).groupBy("kind").count().collect()} == {"tp": 30_000}


def test_scores(spark):
    day = 86_400_000_000
    rows = [(1, 0, day, "tp"), (1, 0, 4 * day, "tp"), (1, 5, None, "fn"), (2, None, 3, "fp"), (3, 5, None, "fn"), (None, 0, 0, "tp")]
    df = spark.createDataFrame(rows, "object long, t_truth long, t_found long, kind string")
    got = {(r.object, r.whole): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1, r.latency_mean, r.latency_median) for r in asof.match_scores(df).collect()}
    assert got == {
        (1, False): (2, 0, 1, 1.0, pytest.approx(2 / 3), 0.8, 2.5, 2.5), (2, False): (0, 1, 0, 0.0, None, 0.0, None, None), (3, False): (0, 0, 1, None, 0.0, 0.0, None, None),
        (None, False): (1, 0, 0, 1.0, 1.0, 1.0, 0.0, 0.0), (None, True): (3, 1, 2, 0.75, 0.6, pytest.approx(6 / 9), pytest.approx(5 / 3), 1.0),
    }


@pytest.mark.parametrize(("span", "least"), [(60, 4), (1000, 4), (1000, 40), (100_000, 40), (100, 0)])
def test_spaced_rows(spark, span, least):
    rng = random.Random(span + least)
    rows = [(rng.choice([1, 2, None]), rng.randrange(span), k, rng.random()) for k in range(250)] + [(9, 5, 0, 1.0), (8, 5, 1, 1.0), (8, 5, 0, 2.0), (1, None, 1000, 0.0)]
    df = spark.createDataFrame(rows, "object long, t long, rec long, value double").repartition(3)
    want = []
    for o in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == o and r[1] is not None), key=lambda r: (r[1], r[2]))
        last = None
        for k, r in enumerate(own):
            if last is None or r[1] - last >= least or k == len(own) - 1:
                want.append(r)
                last = r[1]
    out = kernels.spaced(df, least)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert kernels.spaced(df.limit(0), least).count() == 0
