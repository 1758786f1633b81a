"""What grows with a table: copies of rows, tiles of blocks, draws and kernels in batches."""

import re

import numpy as np
import pytest

from epochal.operators import density, kernels, posterior, vectors


@pytest.mark.parametrize("across", [True, False])
def test_blocks_don_t_grow_with_the_rows(spark, monkeypatch, across):
    # rows were dealt once a 2,048 rows of the table
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 2)
    monkeypatch.setattr(vectors, "BLOCKS", 3, raising=False)
    monkeypatch.setattr(vectors, "TILE", 4, raising=False)
    rng = np.random.default_rng(5)
    rows = [(int(k % 37), int(rng.integers(3)), rng.normal(size=4).tolist()) for k in range(40)]
    out = vectors.distance_sums(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), across=across)
    tasks = int(re.search(r"RepartitionByExpression .*?, (\d+)", out._jdf.queryExecution().optimizedPlan().toString())[1])
    assert tasks == (6 if across else 48)  # of three blocks, however many rows
    want: dict = {}
    for a, c, x in rows:
        for b, d, y in rows:
            if a != b and (across or c == d):
                n, total = want.get((a, c, d), (0, 0.0))
                want[a, c, d] = n + 1, total + float(np.linalg.norm(np.subtract(x, y)))
    got = {(r.id, r.own, r.other): (r.n, r.total) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, (n, total) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(total)


def test_draws_hold_no_series(spark):
    rows = spark.createDataFrame([(o, float(v)) for o in (1, 2) for v in np.random.default_rng(o).normal(3.0, 2.0, 50)] + [(3, 1.0), (4, None), (None, 2.0)], "object long, value double")
    out = kernels.metropolis(rows, steps=300, burn=100)
    # an object's values are reduced before they reach Python
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert {(r.object, r.chain): 0 for r in got}.keys() == {(o, c) for o in (1, 2) for c in (0, 1)} and len(got) == 4 * 200
    # the chain as its values give it, step by step
    y = np.array([r.value for r in rows.where("object = 1").collect()])
    sigma, rng = y.std(ddof=1) + 1e-9, np.random.default_rng([1, 0])
    now, width, hits, want = float(np.median(y)), sigma / np.sqrt(50), 0, []
    log = lambda m: -0.5 * (((y - m) / sigma) ** 2).sum()
    for step in range(300):
        other = now + rng.normal() * width
        if np.log(rng.random()) < log(other) - log(now):
            now, hits = other, hits + 1
        if step < 100 and step % 50 == 49:
            width, hits = width * np.exp(hits / 50 - 0.35), 0
        if step >= 100:
            want.append(now)
    assert [r.x for r in sorted(got, key=lambda r: r.draw) if (r.object, r.chain) == (1, 0)] == pytest.approx(want, rel=1e-9)


def test_kernels_of_circle_and_line_are_sums_of_batches(spark):
    rng = np.random.default_rng(3)
    a, v = rng.uniform(0, 360, 500), rng.normal(7000, 30, 500)
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, v, strict=True)] + [(None, 1.0), (float("nan"), 2.0)], "a double, v double")
    out = density.circular_linear_kde(rows, "a", "v", angles=6, values=5)
    # a row was made a row for every point of the grid
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    h = 1.06 * v.std(ddof=1) * 500**-0.2
    for r in out.collect():
        x = v.min() + (v.max() - v.min()) * r.j / 4
        weight = np.exp(25 * np.cos(2 * np.pi * r.i / 6 - np.radians(a)) - 0.5 * ((x - v) / h) ** 2).sum()
        assert r.value == pytest.approx(x) and r.density == pytest.approx(weight / (2 * np.pi * density._bessel0(25.0) * np.sqrt(2 * np.pi) * 500 * h))
    assert out.count() == 30 and density.circular_linear_kde(rows.limit(0), "a", "v").count() == 0


def test_copies_of_an_object_don_t_grow_with_the_objects(spark, monkeypatch):
    # an object went to a block for every 1,024 objects
    monkeypatch.setattr(posterior, "BLOCK_OBJECTS", 2)
    monkeypatch.setattr(posterior, "BLOCKS", 3, raising=False)
    rng = np.random.default_rng(8)
    values = rng.normal(size=(20, 9))
    out = posterior.wasserstein(spark.createDataFrame([(o, float(x)) for o, v in enumerate(values) for x in v], "object long, x double"))
    assert re.search(r"least\(.*, 3\).*AS __blocks", out._jdf.queryExecution().optimizedPlan().toString())
    shares = np.arange(1, 20) / 20
    q = np.quantile(values, shares, axis=1)
    got = {(r.a, r.b): r.w1 for r in out.collect()}
    assert got.keys() == {(a, b) for a in range(20) for b in range(a + 1, 20)}
    for (a, b), w in got.items():
        assert w == pytest.approx(np.abs(q[:, a] - q[:, b]).mean(), abs=1e-6)


def test_distances_are_compiled(spark):
    """A function over arrays would be interpreted for every pair."""
    values = [(o, float((7 * o + 3 * k * k) % 23)) for o in range(9) for k in range(12)]
    out = posterior.wasserstein(spark.createDataFrame(values, "object long, x double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    own = {o: np.quantile([x for p, x in values if p == o], np.arange(1, 20) / 20) for o in range(9)}
    want = {(a, b): float(np.abs(own[a] - own[b]).mean()) for a in own for b in own if a < b}
    assert {(r.a, r.b): r.w1 for r in out.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
