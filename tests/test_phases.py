"""Phase paths and dwell against a plain walk over whole series."""

import random

import numpy as np
import pytest

from epochal.operators import phases

DAY = 86_400_000_000


def brute(emission, rules):
    """Least cost over a whole series, one state after another."""
    move, n = rules.penalties(), len(emission)
    cost = [[-np.log(max(min(e, 1.0), 1e-9)) for e in row] for row in emission]
    best, back = cost[0], []
    for i in range(1, n):
        came = [min(range(8), key=lambda s, to=to: best[s] + move[s][to]) for to in range(8)]
        best = [best[came[to]] + move[came[to]][to] + cost[i][to] for to in range(8)]
        back.append(came)
    at = [min(range(8), key=lambda s: best[s])]
    for came in back[::-1]:
        at.append(came[at[-1]])
    return [phases.STATES[s] for s in at[::-1]]


def settled(rows, rules):
    out, states = [], [r[1] for r in rows]
    starts = [i for i in range(len(rows)) if i == 0 or states[i] != states[i - 1]]
    spans = [(a, (starts[n + 1] if n + 1 < len(starts) else len(rows)) - 1) for n, a in enumerate(starts)]
    now = [states[a] for a, _ in spans]
    keep = {"insertion_or_orbit_raise": rules.insertion_entry, "disposal_lowering": rules.disposal_entry, "passive_decay": rules.decay_entry}
    for n, (a, b) in enumerate(spans):
        if now[n] in ("unknown", "transition") or rows[b][0] - rows[a][0] >= rules.least_dwell_days * DAY:
            continue
        if now[n] in keep and np.mean([r[2] for r in rows[a : b + 1]]) >= keep[now[n]]:
            continue
        around = (now[n - 1] if n else "", now[n + 1] if n + 1 < len(now) else "")
        now[n] = around[0] if around[0] == around[1] and around[0] not in ("", "unknown") else "transition"
    for (a, b), state in zip(spans, now, strict=True):
        out += [state] * (b - a + 1)
    return out


def series(rng, n):
    rows = []
    for i in range(n):
        raw = [rng.random() ** 3 + 1e-6 for _ in range(8)]
        raw[(i // 9) % 8] += 1.0
        rows.append([x / sum(raw) for x in raw])
    return rows


@pytest.mark.parametrize("chunk", [3, 512])
def test_path_and_dwell(spark, monkeypatch, chunk):
    monkeypatch.setattr(phases, "CHUNK", chunk)
    rng, rules = random.Random(chunk), phases.Rules()
    own = {o: series(rng, n) for o, n in ((1, 60), (2, 10), (3, 1), (4, 9), (5, 33))}
    rows = [(o, 5 * i * DAY, i, e) for o, es in own.items() for i, e in enumerate(es)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, 0, own[1][0])], "object long, t long, rec long, emission array<double>")
    path = phases.cheapest_path(df, rules)
    got = {}
    for r in sorted(path.collect(), key=lambda r: r.rec):
        got.setdefault(r.object, []).append((r.t, r.state, r.score))
    assert got.keys() == own.keys()
    for o, es in own.items():
        states = [s for _, s, _ in got[o]]
        assert states == (brute(es, rules) if len(es) >= 10 else ["unknown"] * len(es))
        assert [s for _, _, s in got[o]] == [e[phases.STATES.index(s)] for e, s in zip(es, states, strict=True)]
    kept = {}
    for r in sorted(phases.least_dwell(path, rules).collect(), key=lambda r: r.rec):
        kept.setdefault(r.object, []).append(r.state)
    assert kept == {o: settled(rows_, rules) for o, rows_ in got.items()}


def test_scores_of_missing_inputs(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, 0.0, 2.0), (None, None, None)], "object long, slope double, variation double")
    got = phases.emissions(df).collect()
    assert all(abs(sum(r.emission) - 1) < 1e-9 and len(r.emission) == 8 for r in got)
    assert phases.emissions(df.drop("slope", "variation")).count() == 3 and phases.emissions(df.limit(0)).count() == 0
