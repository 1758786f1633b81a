"""Spectra of several series and of many objects: cross spectra, coherence, stacks with bootstrap bands, dominant frequencies.

A series is never gathered: points of an even grid stream by in order, and a
task holds the segments of one Arrow batch.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from epochal.operators.kernels import batches_of, even_grid, pieces


def _transforms(batches: Iterable[pa.RecordBatch], segment: int, step: int | None) -> Iterator[tuple]:
    """Of runs of segments of sized grids: ``object``, ``n``, ``width``, first segment, whether the last is among them, transforms (columns by segments by bins) and power of the window.

    Segments are freed of their means and have a Hann window; what does not
    fill one is left out.
    """

    @functools.lru_cache(4096)
    def cut(n: int) -> tuple[np.ndarray, np.ndarray]:
        width = min(segment, n)
        starts = np.arange(0, n - width + 1, step or width - width // 2)
        return starts, starts + width

    for name, n, first, stop, base, points in pieces(batches, cut):
        starts, stops = cut(n)
        width = int(stops[0])
        every = sliding_window_view(points[:, : int(stops[stop - 1]) - base], width, axis=1)[:, int(starts[first]) - base :: step or width - width // 2]
        hann = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(width) / width)
        level = every - every[:, :, :1]
        yield name, n, width, first, stop == len(starts), np.fft.rfft((level - level.mean(2, keepdims=True)) * hann, axis=2), float((hann * hann).sum())


def _sized(df: DataFrame, cadence_days: float, columns: tuple[str, ...], least: int) -> DataFrame:
    grid = even_grid(df, cadence_days, columns, sized=True).where(F.col("n") >= least)
    return grid.select("object", "n", "i", *(F.col(c).cast("double").alias(c) for c in columns))


def _as_schema(df: DataFrame, rest: str) -> StructType:
    """The schema of the object's own type and the columns of ``rest``."""
    return StructType([StructField("object", df.schema["object"].dataType), *StructType.fromDDL(rest).fields])


def cross_spectrum(df: DataFrame, x: str, y: str, cadence_days: float, segment: int = 256, least: int = 8) -> DataFrame:
    """``object``, ``frequency`` (cycles a day), ``csd_real``, ``csd_imag``, densities ``pxx`` and ``pyy`` and ``coherence`` of two series of each object.

    Both are read off the lines between the rows where both are known, on one
    even grid; half-overlapping Hann segments (a shorter series is one
    segment) are freed of their means.  Where a series is constant there is no
    coherence: 0.  Objects of fewer than ``least`` grid points have no rows.
    """
    schema = _as_schema(df, "width long, k long, real double, imag double, xx double, yy double, power double")
    arrow = to_arrow_schema(schema)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[np.ndarray]]]:
        sums, n = 0.0, 0
        for name, _, width, first, ended, found, power in _transforms(batches, segment, None):
            cross = found[0].conj() * found[1]
            if not first:
                sums, n = 0.0, 0
            sums, n = sums + np.stack([cross.real, cross.imag, np.abs(found[0]) ** 2, np.abs(found[1]) ** 2]).sum(1), n + found.shape[1]
            if ended:
                bins = found.shape[2]
                yield name, [np.full(bins, width), np.arange(bins), *(sums / n), np.full(bins, power)]

    mean = _sized(df, cadence_days, (x, y), least).mapInArrow(lambda batches: batches_of(means(batches), arrow), schema)
    # one side of the spectrum: all but the first and the last bin of an even width stand for two
    both = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("width")), 1.0).otherwise(2.0) * cadence_days / F.col("power")
    coherence = F.when((F.col("xx") > 1e-300) & (F.col("yy") > 1e-300), F.least(F.lit(1.0), (F.col("real") * F.col("real") + F.col("imag") * F.col("imag")) / (F.col("xx") * F.col("yy")))).otherwise(0.0)
    return mean.select(
        "object", (F.col("k") / (F.col("width") * cadence_days)).alias("frequency"), *((F.col(a) * both).alias(b) for a, b in (("real", "csd_real"), ("imag", "csd_imag"), ("xx", "pxx"), ("yy", "pyy"))), coherence.alias("coherence")
    )


def averaged(found: DataFrame, by: str, *values: str) -> DataFrame:
    """Means of values over all objects that have a row at ``by``, and how many those are."""
    return found.groupBy(by).agg(F.count_distinct("object").alias("n_objects"), *(F.avg(v).alias(v) for v in values))


def lag_correlations(df: DataFrame, x: str, y: str, cadence_days: float, lags: int, overlap: bool = False, least: int = 4) -> DataFrame:
    """``object``, ``lag`` (steps by which ``x`` comes later, both signs), ``n`` and ``r`` of two series on one even grid.

    Products over the overlap are divided by both deviations of the whole
    series and by its length, or (``overlap``) by the overlap's.
    """
    grid = even_grid(df, cadence_days, (x, y), sized=True).where(F.col("n") >= least)
    w, own = Window.partitionBy("object").orderBy("i"), Window.partitionBy("object")
    rows = grid.withColumns({"sd": F.stddev_pop(x).over(own) * F.stddev_pop(y).over(own), "__a": F.col(x) - F.avg(x).over(own), "__b": F.col(y) - F.avg(y).over(own)})
    # a negative lag pairs x with a later y, a positive one with an earlier y; an object is one row of sums, one a lag
    later = {k: (F.lag("__b", k) if k >= 0 else F.lead("__b", -k)).over(w) for k in range(-lags, lags + 1)}
    rows = rows.withColumns({f"__z{j}": z for j, z in enumerate(later.values())})
    wide = rows.groupBy("object", "n", "sd").agg(*(F.sum(F.col("__a") * F.col(f"__z{j}")).alias(f"__s{j}") for j in range(len(later))))
    sums = wide.select("object", "n", "sd", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"__s{j}").alias("s")) for j, k in enumerate(later)))).alias("p")).select("object", "n", "sd", "p.*").where("s IS NOT NULL")
    length = F.col("n") - F.abs("lag") if overlap else F.col("n")
    return sums.select("object", "lag", "n", F.try_divide(F.col("s"), F.col("sd") * length).alias("r"))


def mean_lag_correlation(found: DataFrame) -> DataFrame:
    """Mean correlation a lag over the objects, on the lags that the shortest of them has."""
    own = found.where("r IS NOT NULL")
    reach = own.groupBy("object").agg(F.max(F.abs("lag")).alias("m")).agg(F.min("m").alias("reach"))
    return own.join(F.broadcast(reach)).where(F.abs("lag") <= F.col("reach")).groupBy("lag").agg(F.count("*").alias("n_objects"), F.avg("r").alias("r"))


#: Shares of objects that are drawn at most 0, 1, 2, ... times (a Poisson count of mean one).
DRAWN = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def drawn_share(object_: Column, replicate: Column) -> Column:
    """A number in [0, 1) that follows from a hash of both."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", object_.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def draws(share: Column) -> Column:
    """How often an object is drawn: a Poisson count of such a share, which should be a column of its own (it is compared many times)."""
    return sum(((share >= s).cast("int") for s in DRAWN), F.lit(0))


def on_common_grid(spectra: DataFrame, normalise: bool = True) -> DataFrame:
    """``object``, ``frequency``, ``y``: spectra on the lines between their bins at the frequencies of the first object (the smallest).

    ``normalise`` divides each by its largest amplitude.  Frequencies that an
    object's own do not reach are left out for it.  Spectra of one bin are none.
    """
    own = spectra.where("object IS NOT NULL AND amplitude IS NOT NULL").groupBy("object").agg(F.array_sort(F.collect_list(F.struct("frequency", "amplitude"))).alias("bins"), F.max("amplitude").alias("top")).where("size(bins) > 1")
    common = own.agg(F.min_by(F.transform("bins", lambda b: b["frequency"]), "object").alias("at"))
    each = own.join(F.broadcast(common)).withColumn("frequency", F.explode("at"))
    below = F.array_max(F.filter("bins", lambda b: b["frequency"] <= F.col("frequency")))
    above = F.array_min(F.filter("bins", lambda b: b["frequency"] >= F.col("frequency")))
    each = each.withColumns({"a": below, "b": above}).where("a IS NOT NULL AND b IS NOT NULL")
    gap = F.col("b.frequency") - F.col("a.frequency")
    y = F.when(gap > 0, F.col("a.amplitude") + (F.col("b.amplitude") - F.col("a.amplitude")) * (F.col("frequency") - F.col("a.frequency")) / gap).otherwise(F.col("a.amplitude"))
    return each.select("object", "frequency", (y / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) if normalise else y).alias("y"))


def stacked_spectrum(spectra: DataFrame, replicates: int = 64, normalise: bool = True) -> DataFrame:
    """``frequency``, ``n_members``, ``amplitude`` (median over the objects), ``p05`` and ``p95`` of bootstrap medians.

    A replicate counts every object as often as ``draws`` says, inside one
    aggregation by frequency and replicate: a median with whole weights.  The
    objects themselves are the replicate -1, in which each counts once.
    An object is drawn once a replicate, not again at each frequency.
    Frequencies of the common grid are few; the objects' different amplitudes
    at one frequency and replicate meet in one task.
    """
    # rows of an object are in one task already
    whole = on_common_grid(spectra, normalise).groupBy("object").agg(F.collect_list(F.struct("frequency", "y")).alias("points"))
    each = whole.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    # the least share of one draw: told before the counts, so that these need not be worked out for the filter
    each = each.withColumn("share", F.when(F.col("replicate") < 0, DRAWN[0]).otherwise(drawn_share(F.col("object"), F.col("replicate")))).where(F.col("share") >= DRAWN[0])
    rows = each.withColumn("times", draws(F.col("share"))).select("replicate", "times", F.inline("points"))
    medians = rows.groupBy("frequency", "replicate").agg(F.count("*").alias("n"), F.percentile("y", F.lit(0.5), F.col("times")).alias("m"))
    plain, drawn = (lambda c: F.max(F.when(F.col("replicate") < 0, F.col(c)))), F.when(F.col("replicate") >= 0, F.col("m"))
    return medians.groupBy("frequency").agg(plain("n").alias("n_members"), plain("m").alias("amplitude"), F.percentile(drawn, F.lit(0.05)).alias("p05"), F.percentile(drawn, F.lit(0.95)).alias("p95"))


def dominant_frequencies(df: DataFrame, cadence_days: float, window: int = 256, step: int = 64, value: str = "value") -> DataFrame:
    """``object``, ``s``, ``frequency``, ``power``: the strongest bin above zero of every window of the even grid, slid by ``step``; of equal ones the lowest."""
    schema = _as_schema(df, "s long, frequency double, power double")
    arrow = to_arrow_schema(schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[np.ndarray]]]:
        for name, _, width, first, _, found, _ in _transforms(batches, window, step):
            power = np.abs(found[0, :, 1:]) ** 2
            at = power.argmax(1)
            yield name, [first + np.arange(len(at)), (at + 1) / (width * cadence_days), power[np.arange(len(at)), at]]

    return _sized(df, cadence_days, (value,), window).mapInArrow(lambda batches: batches_of(best(batches), arrow), schema)


def frequency_diffusion(found: DataFrame) -> DataFrame:
    """Of each object the deviation of steps between the dominant frequencies of windows that follow each other; one window: null."""
    w = Window.partitionBy("object").orderBy("s")
    steps = found.withColumn("__d", F.col("frequency") - F.lag("frequency").over(w))
    return steps.groupBy("object").agg(F.count("*").alias("n_windows"), F.stddev_pop("__d").alias("diffusion"))
