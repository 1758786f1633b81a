"""What ``evidence`` makes of a batch of objects, in NumPy: signals and masks of the detectors, supported rows and their runs.

Matrices are those of ``signals``; ``cfg`` has the fields of
``evidence.Settings``.  A worker imports this module and ``signals`` alone.
"""

from __future__ import annotations

import numpy as np

from epochal.operators import signals as s

HOUR = 3600
LEAST_RECORDS = 10
CHANNELS = ("sma", "mean_motion", "inc", "ecc", "raan", "bstar")
FIELDS = CHANNELS[:5]
ENERGY = ("sma", "mean_motion", "energy", "ecc")
PLANE = ("inc", "raan")


def features(own: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, mu: float, cfg) -> dict[str, np.ndarray]:
    """Every signal of the detectors; ``own``: the channels, ``x``: seconds, ``n``: rows of each object."""
    gap, half = x - s.shifted(x, 1), cfg.trend_rows // 2
    out = {"dt": gap, "energy": np.where(own["sma"] != 0, -mu / (2 * own["sma"]), np.nan)}
    for c in ("sma", "inc"):
        out[f"local_{c}"] = own[c] - s.means(own[c], -half, half, max(3, cfg.trend_rows // 3))
    out |= {f"d1_{c}": s.rate(own[c], x) for c in FIELDS}
    # both in one walk over the rows
    smooth = np.split(s.exponential(np.concatenate([own["sma"], own["inc"]]), cfg.smooth_span), 2)
    for c, v in zip(("sma", "inc"), smooth, strict=True):
        out[f"e1_{c}"] = s.rate(v, x)
        out[f"e2_{c}"] = s.rate(out[f"e1_{c}"], x)
    channels = (*ENERGY, *PLANE)
    steps = s.line_steps(x, [out["energy"] if c == "energy" else own[c] for c in channels], n, cfg.line_rows)
    out |= {f"step_{c}": v for c, v in zip(channels, steps, strict=True)}
    for c in FIELDS:
        before = s.shifted(out[f"d1_{c}"], 1)
        guess = s.shifted(own[c], 1) + np.where(np.isnan(before), 0.0, before) * gap
        out[f"miss_{c}"] = np.where(gap > 0, own[c] - guess, np.nan)
    out["e_anomaly"] = most([np.abs(own[c] - s.shifted(own[c], 1)) / scale for c, scale in cfg.jump_scales.items()])
    for name, parts in (("energy", ENERGY), ("plane", PLANE)):
        v = np.array([out[f"step_{c}"] for c in parts])
        known = (~np.isnan(v)).sum(0)
        out[f"{name}_step"] = np.where(known > 0, np.where(np.isnan(v), 0.0, v).sum(0) / np.maximum(known, 1), np.nan)
    return out


def most(values: list[np.ndarray]) -> np.ndarray:
    """The largest known value, or 0."""
    out = values[0]
    for v in values[1:]:
        out = np.fmax(out, v)
    return np.where(np.isnan(out), 0.0, out)


def detect(own: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, mu: float, cfg, full: bool = True) -> dict[str, np.ndarray]:
    """Masks and evidence of every family, prominences, steps and jumps; not ``full``: masks and evidence of the families alone."""
    valid = np.arange(x.shape[1]) < n[:, None]
    own = dict(own)
    f = features(own, x, n, mu, cfg)
    column = lambda v: v[:, None]
    # signals gated by their own robust scales, all in one matrix
    names = [*(f"local_{c}" for c in ("sma", "inc")), *(f"step_{c}" for c in (*ENERGY, *PLANE))]
    v, tall = np.concatenate([f[c] for c in names]), np.concatenate([valid] * len(names))
    prominent = s.prominence(v, tall, cfg.prominence_rows)
    least = np.fmax(0.0, s.middle(prominent) + cfg.prominence_sigmas * s.clipped(prominent, 2, 4.0))
    z = np.abs(v - column(s.middle(v))) / column(np.fmax(1e-9, s.clipped(v, 3, 4.5)))
    z = np.where(np.isnan(z), 0.0, z)
    mask = (z >= cfg.sigma) & s.peaks(v, prominent, column(least))
    z, mask = np.split(z, len(names)), np.split(mask, len(names))
    # the miss of a prediction: each field's own deviation, the mean of those known
    miss = np.concatenate([f[f"miss_{c}"] for c in FIELDS])
    far = np.array(np.split(np.abs(miss) / column(s.clipped(miss, 3, 4.5)), len(FIELDS)))
    known = (~np.isnan(far)).sum(0)
    missed = np.where(valid, np.where(known > 0, np.where(np.isnan(far), 0.0, far).sum(0) / np.maximum(known, 1), 0.0), np.nan)
    p_missed = s.prominence(missed, valid, cfg.prominence_rows)
    least = np.fmax(0.0, s.middle(p_missed) + cfg.prominence_sigmas * s.clipped(p_missed, 2, 4.0))
    fast = most([np.abs(f[f"e{k + 1}_{c}"]) / limit for c, limits in cfg.rate_limits.items() for k, limit in enumerate(limits)])
    here = lambda a: np.where(valid, a, np.nan)
    out = {
        "m_local": s.bridged(mask[0] | mask[1], cfg.gap_rows),
        "e_local": here(np.fmax(z[0], z[1])),
        "m_filtered": np.any(mask[2:], axis=0),
        "e_filtered": here(np.max(z[2:], axis=0)),
        "m_smoothed": s.bridged(s.widened((fast >= 1) & valid, cfg.hysteresis) & valid, cfg.gap_rows),
        "e_smoothed": here(fast),
        "m_predicted": (missed >= cfg.predicted_sigma) & s.peaks(missed, p_missed, column(least)),
        "e_predicted": missed,
    }
    if not full:
        return out
    high = (f["e_anomaly"] > cfg.anomaly_sigma) & valid
    out |= {"m_anomaly": high & ~s.shifted(high, 1) & ~s.shifted(high, -1), "e_anomaly": here(f["e_anomaly"])}
    slope = np.where(valid, np.where(np.isnan(f["e1_sma"]), 0.0, f["e1_sma"]), np.nan)
    out |= {"p_filtered": s.prominence(f["energy_step"], valid, cfg.prominence_rows), "p_smoothed": s.prominence(slope, valid, cfg.prominence_rows), "p_predicted": p_missed}
    out |= {k: f[k] for k in ("energy_step", "plane_step", "d1_sma")} | {"bstar": own["bstar"]}
    d1 = np.abs(f["d1_sma"])
    scale = s.rolling_scale(f["d1_sma"], 9)
    floor = s.middle(scale)
    floor = np.fmax(np.where(np.isnan(floor), 1.0, floor), 1e-6)
    scale = s.filled(scale)
    out["sustained"] = np.abs(s.means(f["d1_sma"], -4, 4, 3)) / np.where(scale > 1e-9, scale, column(floor))
    jumped = here((d1 > column(s.middle(d1) + 2 * s.clipped(d1, 2, 4.0))).astype(float))
    often = s.means(jumped, -7, 7, 3)
    out["upkeep"] = here(np.where(np.isnan(often), 0.0, often))
    cadence = s.middle(f["dt"])
    varies = np.where(cadence != 0, s.spread(f["dt"]) / cadence, np.nan)
    out |= {"cadence": here(column(cadence)), "cadence_cv": here(column(np.where(np.isnan(varies), 0.0, varies)))}
    return out | {f"{side}_{c}": s.means(own[c], *rows) for c in ("sma", "inc") for side, rows in (("pre", (-5, -1)), ("post", (1, 5)))}


def support(found: dict[str, np.ndarray], n: np.ndarray, cfg) -> np.ndarray:
    """Rows of any family's mask, gaps filled; in objects without any, rows of high evidence, or else the rows around the peak."""
    place = np.arange(found["e_local"].shape[1])
    valid = (place < n[:, None]) & (n[:, None] >= LEAST_RECORDS)
    out = s.bridged(np.any([s.bridged(found[f"m_{f}"], cfg.gap_rows) for f in cfg.families], axis=0), cfg.gap_rows) & valid
    bare = np.flatnonzero(~out.any(1) & (n >= LEAST_RECORDS))
    if not len(bare):
        return out
    valid, high, best = valid[bare], np.zeros((len(bare), len(place)), bool), np.full((len(bare), len(place)), -np.inf)
    for f in cfg.families:
        e = np.where(valid, found[f"e_{f}"][bare], np.nan)
        mid, sigma = s.deviation(e)
        limit = np.fmax(0.6, np.fmax(mid + 1.2 * sigma, s.quantile(e, 0.85)))
        high, best = high | (e >= limit[:, None]), np.fmax(best, e)
    high = s.bridged(high, max(1, cfg.gap_rows))
    peak = best.argmax(1)
    near = (np.abs(place - peak[:, None]) <= 1) & (best.max(1) >= 0.7)[:, None] & valid
    out[bare] = np.where(high.any(1)[:, None], high, near)
    return out


def runs(found: dict[str, np.ndarray], t: np.ndarray, n: np.ndarray, cfg) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Runs of supported rows: the object of each (a row's number), and what ``evidence.scored`` asks of it."""
    on = support(found, n, cfg)
    begin = np.flatnonzero((on & ~s.shifted(on, 1))[on])
    end = np.append(begin[1:], on.sum())[: len(begin)] - 1
    object_, place = np.nonzero(on)
    of = lambda c: found[c][on]
    total = lambda v: np.add.reduceat(v, begin) if len(begin) else np.zeros(0, v.dtype)
    top = lambda v: np.fmax.reduceat(v, begin) if len(begin) else v[:0]

    def mean(v: np.ndarray) -> np.ndarray:
        known = ~np.isnan(v)
        count = total(known.astype(int))
        return np.where(count > 0, total(np.where(known, v, 0.0)) / np.maximum(count, 1), np.nan)

    nought = lambda v: np.where(np.isnan(v), 0.0, v)
    shown = [of(f"p_{f}") for f in ("filtered", "smoothed", "predicted") if f in cfg.families]
    missed, t = of("e_predicted"), t[on]
    hit = np.flatnonzero((missed >= cfg.predicted_sigma) & ("predicted" in cfg.families))
    run = np.repeat(np.arange(len(begin)), end - begin + 1)
    # the first hit of each run
    which, first = np.unique(run[hit], return_index=True)
    t_missed = np.full(len(begin), None, object)
    t_missed[which] = t[hit[first]]
    steps = "filtered" in cfg.families
    out = {"segment": np.arange(len(begin)) - np.searchsorted(object_[begin], object_[begin]) + 1, "first_row": place[begin] + 1, "last_row": place[end] + 1, "t_start": t[begin], "t_end": t[end], "support_points": end - begin + 1}
    for f in ("local", "filtered", "smoothed", "predicted"):
        own = f in cfg.families
        out[f"m_{f}"] = total(of(f"m_{f}").astype(int)) > 0 if own else np.zeros(len(begin), bool)
        out[f"e_{f}"], out[f"a_{f}"] = (top(of(f"e_{f}")), mean(of(f"e_{f}"))) if own else (np.full(len(begin), np.nan),) * 2
    out |= {"prominence": top(np.max(shown, axis=0)) if shown else np.zeros(len(begin)), "anomaly_score": top(of("e_anomaly")), "cadence": of("cadence")[begin], "cadence_cv": of("cadence_cv")[begin]}
    out |= {f"{k}_signal": nought(mean(of(f"{k}_step"))) if steps else np.zeros(len(begin)) for k in ("energy", "plane")}
    out |= {"bstar_level": mean(np.abs(of("bstar"))), "sustained": mean(of("sustained")), "upkeep": mean(of("upkeep")), "slope_day": nought(mean(of("d1_sma"))) * 24 * HOUR, "t_missed": t_missed, "missed": top(missed)}
    out |= {f"pre_{c}": of(f"pre_{c}")[begin] for c in ("sma", "inc")} | {f"post_{c}": of(f"post_{c}")[end] for c in ("sma", "inc")}
    return object_[begin], out
