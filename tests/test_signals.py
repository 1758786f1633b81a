"""Signals of many series at once against one series after another."""

import numpy as np
import pytest

from epochal.operators import detectors, evidence, signals

NAN = float("nan")


@pytest.fixture
def some():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 40))
    n = np.array([40, 1, 7, 25, 40, 33])
    v[rng.random(v.shape) < 0.2] = NAN
    v[4] = NAN
    v[5, :30] = 2.0
    v[~(np.arange(40) < n[:, None])] = NAN
    return v, n


def known(v):
    return v[~np.isnan(v)]


def test_scales_of_whole_series(some):
    v, _ = some
    assert signals.middle(v) == pytest.approx([np.median(known(x)) if len(known(x)) else NAN for x in v], nan_ok=True)
    assert signals.quantile(v, 0.85) == pytest.approx([np.quantile(known(x), 0.85) if len(known(x)) else NAN for x in v], nan_ok=True)
    assert signals.spread(v) == pytest.approx([known(x).std() if len(known(x)) else NAN for x in v], nan_ok=True)
    assert signals.middle(np.array([[np.inf, 1.0, 3.0]]))[0] == 2.0
    v[0, :2] = 90.0, -70.0
    for x, got in zip(v, signals.clipped(v, 3, 4.5), strict=True):
        own = known(x)

        def scale(u):
            mad = np.median(abs(u - np.median(u)))
            return (1.4826 * mad if mad > 1e-12 else u.std()) or 1.0

        for _ in range(3 if len(own) else 0):
            kept = own[abs(own - np.median(own)) <= 4.5 * scale(own)]
            own = kept if len(kept) >= 8 else own
        assert got == pytest.approx(scale(own) if len(own) else 1.0)


@pytest.mark.parametrize("cells", [signals.CELLS, 12])
def test_scales_of_the_places_around(some, monkeypatch, cells):
    """Also a few places at a time, as in long series."""
    monkeypatch.setattr(signals, "CELLS", cells)
    v, n = some
    valid = np.arange(40) < n[:, None]
    got, scale = signals.prominence(v, valid, 11), signals.rolling_scale(v, 9)
    for r in range(len(v)):
        far, mad = [], []
        for k in range(n[r]):
            near, small = known(v[r, max(0, k - 5) : k + 6]), known(v[r, max(0, k - 4) : k + 5])
            far.append(abs(v[r, k] - np.median(near)) if len(near) >= 3 else NAN)
            mad.append(1.4826 * np.median(abs(small - np.median(small))) if len(small) >= 3 else NAN)
        want = [next((x for x in [*far[k:], *far[:k][::-1]] if x == x), 0.0) for k in range(n[r])]
        assert got[r, : n[r]] == pytest.approx(want) and np.isnan(got[r, n[r] :]).all()
        assert scale[r, : n[r]] == pytest.approx(mad, nan_ok=True)
    x = np.where(valid, np.arange(40.0) ** 1.5, NAN)
    steps = signals.line_steps(x, [v], n, 4)[0]
    for r in range(len(v)):
        for k in range(40):
            ends = []
            for rows in (range(k + 1, k + 5), range(k - 4, k)):
                own = [j for j in rows if 4 <= k < n[r] - 5 and v[r, j] == v[r, j]]
                ends.append(np.polyval(np.polyfit(x[r, own], v[r, own], 1), x[r, k + 1]) if len(own) >= 3 else NAN)
            assert steps[r, k] == pytest.approx(ends[0] - ends[1], abs=1e-9, nan_ok=True)


def test_neighbours():
    v = np.array([[1.0, NAN, 4.0, 8.0, NAN]])
    assert signals.means(v, -1, 1, 2)[0] == pytest.approx([NAN, 2.5, 6.0, 6.0, NAN], nan_ok=True)
    assert signals.filled(v)[0].tolist() == [1.0, 4.0, 4.0, 8.0, 8.0]
    assert signals.exponential(v, 3)[0].tolist() == [1.0, 1.0, 2.5, 5.25, 5.25]
    assert signals.rate(v, np.array([[0.0, 1.0, 2.0, 4.0, 4.0]]))[0] == pytest.approx([NAN, NAN, NAN, 2.0, NAN], nan_ok=True)
    mask = np.array([[c == "1" for c in "010010001"]])
    assert ["".join("01"[int(b)] for b in signals.bridged(mask, gap)[0]) for gap in range(4)] == ["010010001", "010010001", "011110001", "011111111"]
    assert signals.shifted(v, 9).shape == v.shape and np.isnan(signals.shifted(v, -9)).all()


def test_rows_of_high_evidence_support_objects_without_masks():
    cfg = evidence.Settings(families=("local",))
    n = np.array([20, 20, 9, 20])
    e = np.where(np.arange(20) < n[:, None], 0.01, NAN)
    e[0, 7:9], e[1, 12], e[2, 3] = 3.0, 0.65, 5.0
    found = {"e_local": e, "m_local": np.zeros((4, 20), bool)}
    on = detectors.support(found, n, cfg)
    assert [np.flatnonzero(r).tolist() for r in on] == [[7, 8], [12], [], []]
