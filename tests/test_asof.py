"""As-of joins: buckets of a hot object, names on both sides, steps linear in the rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from epochal.operators import asof


def brute(left, right, tolerance, tie):
    out = []
    for o, rec, t in left:
        there = [(abs(u - t), u if tie == "earlier" else -u, u, r) for p, r, u, _ in right if p == o and p is not None]
        if o is None or not there:
            out.append((o, rec, None, None))
            continue
        gap, _, u, _ = min(there, key=lambda x: x[:2])
        ranks = [r for _, _, v, r in there if v == u]
        out.append((o, rec, u, max(ranks) if u <= t else min(ranks)) if gap <= tolerance else (o, rec, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [7, 100_000])
@pytest.mark.parametrize("tie", ["earlier", "later"])
def test_nearest_over_buckets(spark, monkeypatch, rows, tie):
    monkeypatch.setattr(asof, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    left = [(rng.choice([1, 1, 1, 2, 3]), n, rng.randint(0, 400)) for n in range(150)] + [(9, 999, 5)]
    right = [(rng.choice([1, 1, 1, 2]), n, rng.choice([rng.randint(0, 60), rng.randint(300, 400)]), float(n)) for n in range(120)]
    got = asof.nearest(spark.createDataFrame(left, "object long, rec long, t long"), spark.createDataFrame(right, "object long, rec long, t long, value double"), 50, tie)
    assert sorted((tuple(r) for r in got.select("object", "rec", "near_t", "near_rec").collect()), key=str) == brute(left, right, 50, tie)


def test_interpolation_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(asof, "BUCKET_ROWS", 5)
    left = spark.createDataFrame([(1, n, 7 * n) for n in range(40)], "object long, rec long, t long")
    right = spark.createDataFrame([(1, n, 50 * n, 5.0 * n) for n in range(1, 5)], "object long, rec long, t long, value double")
    got = {r.rec: r.interpolated_value for r in asof.interpolated(left, right).collect()}
    assert all(got[n] == (pytest.approx(0.7 * n) if 50 <= 7 * n <= 200 else None) for n in range(40))


def test_a_long_series_takes_linear_time(spark):
    def seconds(n):
        one = spark.range(n).select(F.lit(1).alias("object"), F.col("id").alias("rec"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("value"))
        start = time.perf_counter()
        assert asof.nearest(one.where("rec % 2 = 0").drop("value"), one.where("rec % 2 = 1")).where("near_t IS NULL").count() == 0
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 40


def test_names_on_both_sides(spark):
    points = spark.createDataFrame([(1, 5, 2.0), (1, 50, 3.0), (2, 5, 4.0), (None, 5, 0.0)], "object long, t long, value double")
    intervals = spark.createDataFrame([(1, 0, 9, 7.0), (1, 5, 5, 8.0), (2, 6, 9, 9.0), (None, 0, 9, 1.0)], "object long, t_start long, t_end long, value double")
    out = asof.in_intervals(points, intervals, 10)
    assert out.columns == ["object", "t", "value", "t_start", "t_end", "interval_value"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, 2.0, 0, 9, 7.0), (1, 5, 2.0, 5, 5, 8.0)]


def test_band_edges_against_all_pairs_in_many_tasks(spark):
    from epochal.plans.joins import band_edges

    rng = random.Random(3)
    rows = [(k, rng.randint(1, 2), float(rng.choice([900, 905, 910]) + rng.randint(0, 40) / 4)) for k in range(200)] + [(200, None, 900.0), (201, 1, None)]
    df = spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double")
    want = {(a[0], b[0], round(1 - abs(a[2] - b[2]) / 5, 6)) for a in rows[:200] for b in rows[:200] if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 5}
    out = band_edges(df, 5.0, task_pairs=1000)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a task has about as many pairs as it may
    assert out.rdd.getNumPartitions() > 4
