"""Density validity against a brute force over all rows."""

import numpy as np
import pytest

from epochal.operators import validity


def brute(x, label):
    cores, inner, sparse = {}, {}, {}
    far = lambda a, b: np.sqrt(((a[:, None] - b) ** 2).sum(2))
    for c in sorted(set(label[label >= 0])):
        at = np.flatnonzero(label == c)
        d = far(x[at], x[at])
        with np.errstate(divide="ignore"):
            sums = np.where(d > 0, (1 / np.where(d > 0, d, 1)) ** x.shape[1], 0).sum(1)
        core = np.array([(s / (len(at) - 1)) ** (-1 / x.shape[1]) if s else 0.0 for s in sums])
        m = np.maximum(d, np.maximum(core[:, None], core))
        own, edges = list(range(len(at))), []
        for w, i, j in sorted((m[i, j], i, j) for i in range(len(at)) for j in range(i)):
            if own[i] != own[j]:
                edges.append((w, i, j))
                a, b = own[i], own[j]
                own = [b if o == a else o for o in own]
        degree = np.bincount([v for _, i, j in edges for v in (i, j)], minlength=len(at))
        sparse[c] = max([w for w, i, j in edges if degree[i] > 1 and degree[j] > 1] or [w for w, _, _ in edges])
        inner[c] = at[degree > 1] if (degree > 1).any() else at[:1]
        cores[c] = dict(zip(at, core, strict=True))
    out, total = {}, 0.0
    for c in sparse:
        sep = min(max(far(x[i : i + 1], x[j : j + 1])[0, 0], cores[c][i], cores[o][j]) for o in sparse if o != c for i in inner[c] for j in inner[o])
        v = (sep - sparse[c]) / max(sep, sparse[c])
        out[c] = ((label == c).sum(), sparse[c], sep, v)
        total += (label == c).sum() / len(label) * v
    return out, total


@pytest.mark.parametrize("rows", [16, 2048])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(validity, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(4)
    label = np.array([0] * 70 + [1] * 40 + [2] * 2 + [-1] * 5)
    x = rng.normal(size=(len(label), 3)) + 6.0 * label[:, None]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "id long, label int, v array<double>")
    want, total = brute(x, label)
    got = validity.density_validity(df, 3).collect()
    assert {r.label for r in got} == set(want)
    for r in got:
        assert (r.n, r.sparseness, r.separation, r.validity, r.total) == pytest.approx((*want[r.label], total), rel=1e-8)


def test_all_rows_of_a_large_label(spark, tmp_path):
    """2,500 rows of one label: all are counted, none is left out by a cap."""
    from epochal import catalog

    rng = np.random.default_rng(5)
    rows = [(i, int(i >= 2500), [float(v) for v in rng.normal(size=64)]) for i in range(2600)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.label: r.n for r in catalog.queries()["density_validity"](spark, str(tmp_path)).collect()} == {0: 2500, 1: 100}


def test_rounds_do_not_multiply_the_estimated_size(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, rng.normal(size=2).tolist(), 0.1) for i in range(60)]
    edges = validity.tree(spark.createDataFrame(rows, "g long, id long, v array<double>, core double"))
    assert edges.count() == 59
    assert int(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) < 10**9
