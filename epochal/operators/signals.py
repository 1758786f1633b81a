"""Signals of many series at once, in NumPy: a row of a matrix is a series in order, NaN is unknown or beyond its end.

These are the steps of functions over Arrow batches; a worker imports this
module alone.  Masks are matrices of booleans, false beyond the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a matrix of several series; a longer series has a matrix of its own.
CELLS = 32_768


# -- rows of a partition in order of their objects -----------------------------------------
def whole_objects(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole objects and the numbers of their rows, from batches in which an object's rows follow each other; about ``CELLS`` cells each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("object")
        cuts = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column("object")[-1] != names[0]:
            cuts = np.concatenate(([0], cuts))
        if not len(cuts):
            held.append(batch)
            continue
        yield from _pieces([*held, batch.slice(0, cuts[-1])])
        held = [batch.slice(cuts[-1])]
    if held:
        yield from _pieces(held)


def _pieces(batches: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    names = rows.column("object").combine_chunks()
    begin = np.concatenate(([0], np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(names)]))
    lengths, first = np.diff(begin), 0
    longest = 0
    for k, n in enumerate(lengths):
        if k > first and max(longest, n) * (k - first + 1) > CELLS:
            yield rows.slice(begin[first], begin[k] - begin[first]), lengths[first:k]
            first, longest = k, 0
        longest = max(longest, n)
    yield rows.slice(begin[first]), lengths[first:]


def matrix(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rows one after another as a matrix; ``valid``: where it has rows."""
    out = np.full(valid.shape, np.nan if values.dtype.kind == "f" else 0, values.dtype)
    out[valid] = values
    return out


def number(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


# -- neighbours ------------------------------------------------------------------------------
def shifted(v: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places before (after, if it is negative)."""
    out = np.full(v.shape, np.nan if v.dtype.kind == "f" else 0, v.dtype)
    if 0 <= by < v.shape[1]:
        out[:, by:] = v[:, : v.shape[1] - by]
    elif -v.shape[1] < by < 0:
        out[:, :by] = v[:, -by:]
    return out


def windows(v: np.ndarray, near: int) -> np.ndarray:
    """The places around each place."""
    padded = np.pad(v, ((0, 0), (near, near)), constant_values=np.nan)
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * near + 1, axis=1)


def around(v: np.ndarray, near: int, made) -> np.ndarray:
    """What ``made`` gives for the sorted values around each place and the number of those known, a block of places at a time."""
    step = max(1, CELLS // len(v))
    out = []
    for k in range(0, v.shape[1], step):
        own = np.sort(windows(v, near)[:, k : k + step], axis=-1)
        out.append(made(own, (~np.isnan(own)).sum(-1)))
    return np.concatenate(out, axis=1)


def means(v: np.ndarray, first: int, last: int, least: int = 1) -> np.ndarray:
    """Mean of the known values from ``first`` to ``last`` places after each place, where there are ``least``."""
    known = ~np.isnan(v)
    before, size = max(0, -first), v.shape[1]
    values, some = (np.pad(a, ((0, 0), (before, max(0, last)))) for a in (np.where(known, v, 0.0), known))
    total, n = np.zeros(v.shape), np.zeros(v.shape, int)
    for k in range(before + first, before + last + 1):
        total += values[:, k : k + size]
        n += some[:, k : k + size]
    return np.where(n >= least, total / np.maximum(n, 1), np.nan)


def rate(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Change a second since the place before, at the first place that of the second; unknown where no time passed."""
    gap = x - shifted(x, 1)
    out = np.where(gap != 0, (v - shifted(v, 1)) / gap, np.nan)
    if v.shape[1] > 1:
        out[:, 0] = out[:, 1]
    return out


def filled(v: np.ndarray) -> np.ndarray:
    """Unknown values take the next known one, at the end the last one."""
    known, place = ~np.isnan(v), np.arange(v.shape[1])
    ahead = np.minimum.accumulate(np.where(known, place, v.shape[1])[:, ::-1], axis=1)[:, ::-1]
    back = np.maximum.accumulate(np.where(known, place, 0), axis=1)
    return np.take_along_axis(v, np.where(ahead < v.shape[1], ahead, back), axis=1)


def exponential(v: np.ndarray, span: int) -> np.ndarray:
    """Recursive means of weight 2 / (span + 1): the first known value starts, an unknown one keeps the mean."""
    a, out = 2 / (span + 1), np.empty(v.shape)
    now = np.full(len(v), np.nan)
    for k in range(v.shape[1]):
        x = v[:, k]
        now = np.where(np.isnan(x), now, np.where(np.isnan(now), x, now + a * (x - now)))
        out[:, k] = now
    return out


def peaks(v: np.ndarray, prominence: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places at or beyond both neighbours, up or down, of enough prominence; ends are none."""
    before, after = shifted(v, 1), shifted(v, -1)
    return (((v >= before) & (v >= after)) | ((v <= before) & (v <= after))) & (prominence >= least)


def bridged(mask: np.ndarray, gap: int) -> np.ndarray:
    """A mask with false runs of up to ``gap`` places between true ones filled."""
    out = mask.copy()
    for a in range(1, gap + 1):
        for b in range(1, gap + 2 - a):
            out |= shifted(mask, a) & shifted(mask, -b)
    return out


def widened(mask: np.ndarray, near: int) -> np.ndarray:
    return np.any([shifted(mask, k) for k in range(-near, near + 1)], axis=0)


# -- lines -----------------------------------------------------------------------------------
def line(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least squares of each row's known values, at ``at``; unknown of fewer than three, at a single time the mean."""
    known = ~np.isnan(y)
    n = known.sum(1)
    # of fewer than three values there is no line
    n_ = np.maximum(n, 1)
    mx, my = np.where(known, x, 0.0).sum(1) / n_, np.where(known, y, 0.0).sum(1) / n_
    dx, dy = np.where(known, x - mx[:, None], 0.0), np.where(known, y - my[:, None], 0.0)
    flat = np.where(known, x, -np.inf).max(1) <= np.where(known, x, np.inf).min(1)
    slope = (dx * dy).sum(1) / np.where(flat | (n < 3), 1.0, (dx * dx).sum(1))
    return np.where(n < 3, np.nan, my + np.where(flat, 0.0, slope * (at - mx)))


def lines(x: np.ndarray, values: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """``line`` of several values at the same times, of which rows without an unknown value share what times alone make."""
    mx = x.mean(1)
    dx = x - mx[:, None]
    flat = x.max(1) <= x.min(1)
    lever = np.where(flat, 0.0, (at - mx) / np.where(flat, 1.0, np.einsum("ij,ij->i", dx, dx)))
    out = []
    for y in values:
        my = y.mean(1)
        own = my + lever * np.einsum("ij,ij->i", dx, y - my[:, None])
        odd = np.flatnonzero(np.isnan(own))
        own[odd] = line(x[odd], y[odd], at[odd])
        out.append(own)
    return out


def line_steps(x: np.ndarray, values: list[np.ndarray], n: np.ndarray, rows: int) -> list[np.ndarray]:
    """Lines through the ``rows`` places after and before each place, compared at the place after it; unknown near the ends (``n``: lengths)."""
    size, step = x.shape[1], max(1, CELLS // len(x))
    out = [np.full(x.shape, np.nan) for _ in values]
    for k in range(rows, size - rows, step):
        places = slice(k, min(k + step, size - rows))
        full = np.arange(size)[places] < n[:, None] - rows - 1
        near = lambda v: np.lib.stride_tricks.sliding_window_view(v[:, places.start - rows : places.stop + rows], 2 * rows + 1, axis=1)[full]  # noqa: B023, E731
        steps = steps_around(near(x), [near(v) for v in values], rows)
        for o, own in zip(out, steps, strict=True):
            o[:, places][full] = own
    return out


def steps_around(x: np.ndarray, values: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Of the times and values of ``2 rows + 1`` places around each place: the line after it less that before, at the place after it."""
    # seconds since the place itself
    x = x - x[:, rows : rows + 1]
    at = x[:, rows + 1]
    after, before = lines(x[:, rows + 1 :], [v[:, rows + 1 :] for v in values], at), lines(x[:, :rows], [v[:, :rows] for v in values], at)
    return [a - b for a, b in zip(after, before, strict=True)]


# -- robust scales of whole series -----------------------------------------------------------
def finite(v: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(v), v, np.nan)


def half(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of ``n`` values at the beginning of sorted rows."""
    at = lambda k: np.take_along_axis(ordered, k[..., None], axis=-1)[..., 0]
    return (at(np.maximum(n - 1, 0) // 2) + at(np.minimum(n // 2, ordered.shape[-1] - 1))) / 2


def middle(v: np.ndarray) -> np.ndarray:
    """Median of each series' finite values; unknown without any."""
    v = finite(v)
    return half(np.sort(v, axis=-1), (~np.isnan(v)).sum(-1))


def quantile(v: np.ndarray, share: float) -> np.ndarray:
    v = np.sort(finite(v), axis=-1)
    n = (~np.isnan(v)).sum(-1)
    place = share * np.maximum(n - 1, 0)
    low = place.astype(int)
    at = lambda k: np.take_along_axis(v, k[:, None], axis=-1)[:, 0]
    a, b, part = at(low), at(np.minimum(low + 1, np.maximum(n - 1, 0))), place - low
    return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))


def spread(v: np.ndarray) -> np.ndarray:
    """Deviation of each series' known values; unknown without any."""
    known = ~np.isnan(v)
    n = known.sum(1)
    mean = np.where(known, v, 0.0).sum(1) / np.where(n, n, np.nan)
    return np.sqrt(np.where(known, (v - mean[:, None]) ** 2, 0.0).sum(1) / np.where(n, n, np.nan))


def deviation(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median, and 1.4826 MAD or the deviation where more than half of the finite values are one; unknown without any."""
    v = finite(v)
    mid = middle(v)
    mad = middle(np.abs(v - mid[:, None]))
    sigma, one = 1.4826 * mad, np.flatnonzero(mad <= 1e-12)
    sigma[one] = spread(v[one])
    return mid, sigma


def clipped(v: np.ndarray, rounds: int, clip: float) -> np.ndarray:
    """Robust deviation after clipping rounds, none of which goes below eight values; 1 where there is none."""
    v = finite(v)
    n = (~np.isnan(v)).sum(1)
    mid, sigma = deviation(v)
    live = np.flatnonzero(n)
    for _ in range(rounds):
        own, scale = v[live], sigma[live]
        kept = np.abs(own - mid[live, None]) <= (clip * np.where(scale > 1e-12, scale, 1.0))[:, None]
        left = kept.sum(1)
        # where nothing is clipped no later round clips either
        more = (left >= 8) & (left < n[live])
        live = live[more]
        if not len(live):
            break
        v[live], n[live] = np.where(kept[more], own[more], np.nan), left[more]
        mid[live], sigma[live] = deviation(v[live])
    return np.where(sigma > 1e-12, sigma, 1.0)


# -- robust scales of the places around -------------------------------------------------------
def prominence(v: np.ndarray, valid: np.ndarray, rows: int) -> np.ndarray:
    """Distance of a value from the median around it; where that is unknown the next (or last) known one, or 0."""
    mid = around(v, rows // 2, lambda near, n: np.where(n >= 3, half(near, n), np.nan))
    own = filled(np.abs(v - mid))
    return np.where(valid, np.where(np.isnan(own), 0.0, own), np.nan)


def rolling_scale(v: np.ndarray, rows: int) -> np.ndarray:
    """1.4826 MAD of the values around a place; unknown where fewer than three are known."""
    mad = lambda near, n: half(np.sort(np.abs(near - half(near, n)[..., None]), axis=-1), n)
    return around(v, rows // 2, lambda near, n: np.where(n >= 3, 1.4826 * mad(near, n), np.nan))
