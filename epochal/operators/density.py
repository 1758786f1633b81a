"""Densities over the plane and the torus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hist2d(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Counts and density of square cells ``i``, ``j`` of a side; cells without rows are left out."""
    h = df.groupBy(F.floor(F.col(x) / cell).cast("int").alias("i"), F.floor(F.col(y) / cell).cast("int").alias("j")).agg(F.count("*").alias("n"))
    whole = h.agg(F.sum("n").alias("all"))
    return h.join(F.broadcast(whole)).withColumn("density", F.col("n") / F.col("all") / (cell * cell)).drop("all")


def torus_kde(df: DataFrame, x: str, y: str, cell: float, points: int, kappa: float) -> DataFrame:
    """Product von-Mises weights on a grid, without a norming constant.

    Rows are binned to cells first, so the kernel runs over cells, of which
    there are at most (360 / cell) squared, and not over rows.
    """
    centre = lambda c: F.floor(F.col(c) / cell) * cell + cell / 2
    cells = df.groupBy(centre(x).alias("x"), centre(y).alias("y")).agg(F.count("*").alias("n"))
    step = 360.0 / points
    grid = F.transform(F.sequence(F.lit(0), F.lit(points * points - 1)), lambda k: F.struct((F.floor(k / points) * step).alias("gx"), ((k % points) * step).alias("gy")))
    each = cells.select("x", "y", "n", F.explode(grid).alias("g"))
    near = lambda g, c: F.cos(F.radians(F.col(f"g.{g}") - F.col(c))) - 1
    weight = F.col("n") * F.exp(kappa * near("gx", "x") + kappa * near("gy", "y"))
    return each.groupBy(F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(F.round(F.sum(weight), 4).alias("weight"))


def metrics(h: DataFrame, cells: int) -> DataFrame:
    """Entropy, divergence from uniform over ``cells``, and peak over median of a histogram."""
    whole = h.agg(F.sum("n").alias("all"))
    p = h.join(F.broadcast(whole)).withColumn("p", F.col("n") / F.col("all"))
    return p.agg(
        F.count("*").alias("n_cells"), F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"), F.round(F.sum(F.col("p") * F.log(F.col("p") * cells)), 6).alias("kl_uniform"), F.round(F.max("n") / F.percentile("n", F.lit(0.5)), 6).alias("peak_to_median")
    )


def _bessel0(kappa: float) -> float:
    """The modified Bessel function of order 0, by its series."""
    total = term = 1.0
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= (kappa / 2 / k) ** 2
        total += term
    return total


def _deviation_width(n: Column, deviation: Column, factor: float) -> Column:
    return F.greatest(factor * F.coalesce(deviation, F.lit(1.0)) * F.pow(n, F.lit(-0.2)), F.lit(1e-6))


def kde(df: DataFrame, value: str, points: int = 32, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """``keys``, ``point``, ``x``, ``density``: a Gaussian density of each group at ``points`` places from its least to its largest value.

    The width is the sample deviation times n to the power -1/5.  Groups of
    fewer than three values, or of one value only, have none.  A value adds to
    all places of its group, map-side combined.
    """
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    stat = own.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("sd")).where("n >= 3 AND high > low")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    each = own.join(stat, same).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x, width = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1), F.col("sd") * F.pow("n", F.lit(-0.2))
    each = each.select(*keys, "point", x.alias("x"), "n", width.alias("h"), F.col(value).alias("v"))
    u = (F.col("x") - F.col("v")) / F.col("h")
    return each.groupBy(*keys, "point", "x").agg((F.sum(F.exp(-0.5 * u * u)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def circular_linear_kde(df: DataFrame, angle: str, value: str, angles: int = 12, values: int = 8, kappa: float = 25.0) -> DataFrame:
    """``i``, ``j``, ``angle`` (degrees), ``value``, ``density``: von Mises times Gaussian kernels on a grid of the circle and of the values' range.

    The linear width is 1.06 deviations times n to the power -1/5.  Rows
    without either are left out; an empty table has no grid.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    own = df.where(number(angle) & number(value)).select(F.radians(angle).alias("a"), F.col(value).cast("double").alias("v"))
    stat = own.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("top"), F.stddev_samp("v").alias("sd")).where("n > 0")
    stat = stat.withColumns({"high": F.when(F.col("top") > F.col("low"), F.col("top")).otherwise(F.col("low") + 1.0), "h": _deviation_width(F.col("n"), F.col("sd"), 1.06)})
    turns = 2 * math.pi * np.arange(angles) / angles

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a kernel is a product of its circle's and its line's, so a batch is one product of matrices
        for batch in batches:
            if batch.num_rows:
                a, v, n, h, low, high = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = low[0] + (high[0] - low[0]) * np.arange(values) / (values - 1)
                found = np.exp(kappa * np.cos(turns[:, None] - a)) @ np.exp(-0.5 * ((x - v[:, None]) / h[0]) ** 2)
                i, j = np.divmod(np.arange(angles * values), values)
                one = [np.full(len(i), c) for c in (n[0], h[0])]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(x[j]), pa.array(one[0], pa.int64()), pa.array(one[1]), pa.array(found.ravel())], ["i", "j", "x", "n", "h", "w"])

    each = own.join(F.broadcast(stat)).select("a", "v", "n", "h", "low", "high").mapInArrow(sums, "i int, j int, x double, n long, h double, w double")
    norm = 1.0 / (2 * math.pi * _bessel0(kappa) * math.sqrt(2 * math.pi))
    return each.groupBy("i", "j", "x").agg((F.sum("w") * norm / (F.first("n") * F.first("h"))).alias("density")).select("i", "j", (F.col("i") * (360.0 / angles)).alias("angle"), F.col("x").alias("value"), "density")


def ellipses(df: DataFrame, x: str, y: str, group: str, deviations: float = 2.0) -> DataFrame:
    """``group``, ``n``, centre (``cx``, ``cy``), full ``width`` and ``height`` along the axes of the covariance, and the ``angle`` (degrees) of the longer one.

    Groups of one row have none; rows without a coordinate are left out.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    own = df.where(number(x) & number(y)).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("d")).where("n > 1")
    middle = (F.col("a") + F.col("d")) / 2
    away = F.sqrt((F.col("a") - F.col("d")) * (F.col("a") - F.col("d")) / 4 + F.col("b") * F.col("b"))
    full = lambda v: 2 * deviations * F.sqrt(F.greatest(F.lit(0.0), v))
    return own.select(group, "n", "cx", "cy", full(middle + away).alias("width"), full(middle - away).alias("height"), F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("d")) / 2).alias("angle"))


def feature_columns(df: DataFrame, linear: list[str], angles: list[str]) -> DataFrame:
    """``df`` with ``f_<column>`` of linear columns and ``f_sin_<column>``, ``f_cos_<column>`` of angles (degrees); what is unknown is the column's mean, or 0 if nothing is known."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    made = {f"f_{c}": number(c) for c in linear} | {f"f_{n}_{c}": f(F.radians(number(c))) for c in angles for n, f in (("sin", F.sin), ("cos", F.cos))}
    rows = df.withColumns(made)
    means = rows.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(f"__{n}") for n in made))
    return rows.join(F.broadcast(means)).select(*df.columns, *(F.coalesce(n, f"__{n}").alias(n) for n in made))


def seam_copies(df: DataFrame, x: str, y: str, margin: float = 10.0, half: bool = False) -> DataFrame:
    """Points on a torus (degrees) with copies of those near its seams: ``x`` and ``y`` in [0, 360), or in [-180, 180) if ``half``, and ``copied``.

    A point within ``margin`` of an axis' end is also shown a turn further,
    beyond the other end, and near a corner in all three ways.  Points with an
    unknown angle have no copies on that axis.
    """
    low = -180.0 if half else 0.0
    turned = lambda c: F.pmod(F.col(c).cast("double") - low, F.lit(360.0)) + low
    rows = df.withColumns({x: turned(x), y: turned(y)})
    near = lambda c: F.array_compact(F.array(F.lit(0.0), F.when(F.col(c) <= low + margin, 360.0), F.when(F.col(c) >= low + 360.0 - margin, -360.0)))
    out = rows.withColumns({"__x": F.explode(near(x))}).withColumn("__y", F.explode(near(y)))
    out = out.withColumns({x: F.col(x) + F.col("__x"), y: F.col(y) + F.col("__y"), "copied": (F.col("__x") != 0) | (F.col("__y") != 0)})
    return out.drop("__x", "__y")


def padded(cells: DataFrame, n_i: int, n_j: int, pad: int = 1, circular_i: bool = True, circular_j: bool = True, value: str = "n") -> DataFrame:
    """Cells (``i`` in [0, ``n_i``), ``j`` in [0, ``n_j``)) with ``pad`` more on every side: from the other end of a circular axis, else the edge's own value.

    Cells that are missing stay missing.  A pad may not be longer than an axis.
    """
    if not 0 <= pad <= min(n_i, n_j):
        raise ValueError("a pad is from 0 to the length of an axis")

    def places(c: str, n: int, circular: bool):
        at = F.col(c)
        if circular:
            return F.array_compact(F.array(at, F.when(at >= n - pad, at - n), F.when(at < pad, at + n)))
        edge = F.sequence(F.lit(1), F.lit(pad)) if pad else F.array().cast("array<int>")
        before = F.when(at == 0, F.transform(edge, lambda k: at - k)).otherwise(F.array().cast("array<int>"))
        after = F.when(at == n - 1, F.transform(edge, lambda k: at + k)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(at), before, after)

    own = cells.where(F.col("i").between(0, n_i - 1) & F.col("j").between(0, n_j - 1)).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), value)
    return own.select(F.explode(places("i", n_i, circular_i)).alias("__i"), "j", value).select(F.col("__i").alias("i"), F.explode(places("j", n_j, circular_j)).alias("__j"), value).select("i", F.col("__j").alias("j"), value)
