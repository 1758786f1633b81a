"""Wavelet surfaces of many objects: stacks on common times, ridges, cones of influence, and cross wavelets of two series.

A stack is sums over segments of lines between an object's times.  A cross
wavelet is local in time: series are cut into chunks with as much of their
neighbours as the widest wavelet and the smoothing reach, so a task holds one
chunk, however long a series is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from epochal.operators.kernels import batches_of, even_grid, pieces
from epochal.operators.peaks import grid_maxima

#: Bandwidth and centre of the complex Morlet wavelet, and where it is cut off (in scales).
BANDWIDTH, CENTRE, REACH = 1.5, 1.0, 8.0
#: Smoothing reaches so many deviations.
SIGMAS = 4.0
#: Points of a chunk of a series.
CHUNK = 4096


def stacked(surfaces: DataFrame, grid: Sequence[float], power: str = "z") -> DataFrame:
    """``i`` (number of the time in ``grid``), ``tau_days``, ``frequency``, mean ``power`` and ``n_objects`` of all objects' surfaces at common times.

    ``surfaces`` has ``object``, ``tau_days``, ``frequency`` and a power.  An
    object counts at a time that is one of its own or between two of them, on
    the line between; it does not count outside them.  Rows with a null object,
    time or frequency, or a null or NaN power, take no part; of rows of one
    object, time and frequency the mean counts.
    """
    own = surfaces.where(f"object IS NOT NULL AND tau_days IS NOT NULL AND frequency IS NOT NULL AND {power} IS NOT NULL AND NOT isnan({power})")
    own = own.groupBy("object", "frequency", "tau_days").agg(F.avg(power).alias("__p"))
    w = Window.partitionBy("object", "frequency").orderBy("tau_days")
    rows = own.withColumns({"__t1": F.lead("tau_days").over(w), "__p1": F.lead("__p").over(w)})
    times = F.array(*(F.struct(F.lit(k).alias("i"), F.lit(float(t)).alias("t")) for k, t in enumerate(grid)))
    inside = lambda g: (g["t"] == F.col("tau_days")) | ((g["t"] > F.col("tau_days")) & (g["t"] < F.col("__t1")))
    rows = rows.withColumn("__g", F.explode(F.filter(times, inside)))
    line = F.col("__p") + (F.col("__p1") - F.col("__p")) * (F.col("__g.t") - F.col("tau_days")) / (F.col("__t1") - F.col("tau_days"))
    value = F.when(F.col("__g.t") == F.col("tau_days"), F.col("__p")).otherwise(line)
    return rows.groupBy(F.col("__g.i").alias("i"), F.col("__g.t").alias("tau_days"), "frequency").agg(F.avg(value).alias("power"), F.count("*").alias("n_objects"))


def ridge(stack: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The strongest frequency of each time (``i``, ``tau_days``), of equal ones the lowest, with its power."""
    best = F.max(F.struct("power", (-F.col("frequency")).alias("f"))).alias("__b")
    known = stack.where("power IS NOT NULL AND NOT isnan(power)")
    return known.groupBy(*keys, "i", "tau_days").agg(best).select(*keys, "i", "tau_days", (-F.col("__b.f")).alias("frequency"), F.col("__b.power").alias("power"))


def marked(stack: DataFrame) -> DataFrame:
    """The cells of a stack with ``inside`` (half a period or more from both ends of its times) and ``peak`` (no cell around it is higher, in times and frequencies).

    Times and frequencies are parameters of what made the stack, so numbering
    its frequencies is a small window.
    """
    lines = stack.select("frequency").distinct().withColumn("j", F.row_number().over(Window.orderBy("frequency")) - 1)
    cells = stack.join(F.broadcast(lines), "frequency")
    high = grid_maxima(cells.select("i", "j", "power"), "power").select(F.col("i").alias("__i"), F.col("j").alias("__j"))
    ends = stack.agg(F.min("tau_days").alias("__from"), F.max("tau_days").alias("__to"))
    out = cells.join(F.broadcast(ends)).join(high, (F.col("i") == F.col("__i")) & (F.col("j") == F.col("__j")), "left")
    half = 0.5 / F.col("frequency")
    inside = (F.col("tau_days") >= F.col("__from") + half) & (F.col("tau_days") <= F.col("__to") - half) & (F.col("__to") > F.col("__from"))
    return out.select(*stack.columns, F.coalesce(inside, F.lit(False)).alias("inside"), F.col("__i").isNotNull().alias("peak"))


def _smoother(sigma: float) -> tuple[np.ndarray, int]:
    """Weights of a cut normal curve, and how far they reach."""
    reach = int(SIGMAS * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum(), reach


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places outside [0, n) mirrored at the ends, which count twice."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _chunks(scales: Sequence[float], chunk: int, sigma_scale: float, sigma_time: float, cadence_days: float) -> Callable[..., list[np.ndarray]]:
    """The function of one chunk: a series' points with their neighbours (columns by points, from point ``base`` on) to columns of rows a point and scale."""
    waves = []
    for s in scales:
        k = np.arange(-math.ceil(REACH * s), math.ceil(REACH * s) + 1) / s
        waves.append(np.exp(2j * math.pi * CENTRE * k - k * k / BANDWIDTH) / math.sqrt(math.pi * BANDWIDTH * s))
    over_scales, _ = _smoother(sigma_scale)
    over_time, reach = _smoother(sigma_time)

    def run(n: int, c: int, base: int, points: np.ndarray) -> list[np.ndarray]:
        first = c * chunk
        last = min(n, first + chunk)
        low, high = max(0, first - reach), min(n, last + reach)
        halo = len(waves[-1]) // 2
        series = np.zeros((2, high - low + 2 * halo))
        begin, end = max(low - halo, base), min(high + halo, base + points.shape[1])
        series[:, begin - low + halo : end - low + halo] = points[:, begin - base : end - base]
        both = np.empty((2, len(waves), high - low), complex)
        for k, wave in enumerate(waves):
            cut = halo - len(wave) // 2
            for z in (0, 1):
                both[z, k] = np.correlate(series[z, cut : series.shape[1] - cut], wave, "valid")
        cross = both[0] * both[1].conj()
        at = _mirrored(np.arange(first - reach, last + reach), n) - low

        def smooth(surface: np.ndarray) -> np.ndarray:
            padded = np.pad(surface[:, at], ((len(over_scales) // 2,) * 2, (0, 0)), mode="symmetric")
            by_scale = sum(w * padded[k : k + len(waves)] for k, w in enumerate(over_scales))
            return sum(w * by_scale[:, k : k + last - first] for k, w in enumerate(over_time))

        whole = smooth(np.abs(both[0]) ** 2) * smooth(np.abs(both[1]) ** 2)
        common = np.abs(smooth(cross)) ** 2
        coherence = np.clip(np.divide(common, whole, out=np.zeros_like(whole), where=whole > 1e-300), 0, 1)
        own = cross[:, first - low : last - low]
        scale = np.repeat(np.asarray(scales, float), last - first)
        return [np.tile(np.arange(first, last), len(waves)), scale, CENTRE / (scale * cadence_days), np.abs(own).ravel(), np.angle(own).ravel(), coherence.ravel()]

    return run


def cross_wavelet(df: DataFrame, x: str, y: str, cadence_days: float, scales: Sequence[float], sigma_scale: float = 1.0, sigma_time: float = 1.5, least: int = 16, chunk: int = CHUNK) -> DataFrame:
    """``object``, ``i`` (point of the even grid), ``scale``, ``frequency`` (cycles a day), cross ``power``, ``phase`` (radians) and ``coherence`` of two series of each object.

    Complex Morlet transforms of both series on one even grid, by rising
    ``scales`` (in grid points), beyond its ends zero; coherence is the smoothed cross
    product over the smoothed powers, normal curves over neighbouring scales
    and times, mirrored at the ends; 0 where a series has no power.  Rows
    without an object, time or value take no part; objects (numbers) of fewer
    than ``least`` grid points have no rows.
    """
    if not scales or any(a >= b for a, b in zip(scales, scales[1:], strict=False)) or scales[0] <= 0:
        raise ValueError("scales must rise, from above 0")
    halo = math.ceil(REACH * scales[-1]) + _smoother(sigma_time)[1]
    grid = even_grid(df, cadence_days, (x, y), sized=True).where(F.col("n") >= least)
    points = grid.select(F.col("object").cast("long"), "n", "i", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    run = _chunks(list(scales), chunk, sigma_scale, sigma_time, cadence_days)

    def cut(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, n, chunk)
        return np.maximum(0, at - halo), np.minimum(n, at + chunk + halo)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for name, n, first, stop, base, held in pieces(batches, cut):
            for c in range(first, stop):
                yield name, run(n, c, base, held)

    schema = StructType.fromDDL("object long, i long, scale double, frequency double, power double, phase double, coherence double")
    arrow = to_arrow_schema(schema)
    return points.mapInArrow(lambda batches: batches_of(made(batches), arrow), schema)
