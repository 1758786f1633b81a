"""Robust cleaning and robust lines of an object's series.

Angles are degrees.  NaN counts as null, a null value takes no part in what is
computed but keeps its row; rows without an object or a time are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from epochal.functions.angles import unwrapped
from epochal.operators.evidence import filled, floored, middle, rolling_scale
from epochal.operators.series import days, ordered, whole


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with an object and a time; NaN of the columns becomes null."""
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    return df.where("object IS NOT NULL AND t IS NOT NULL").withColumns(number)


def continuous(df: DataFrame, angle: str, output: str) -> DataFrame:
    """Adds an angle unwrapped over the rows where it is known: whole turns are added where neighbours differ by more than half a turn."""
    # rows without a value stand behind the others, so that neighbours are known rows
    out = df.withColumn("__none", F.col(angle).isNull().cast("int"))
    order = ["__none", "t", "rec"]
    out = out.withColumn("__turn", unwrapped(F.col(angle), ["object"], order))
    run = Window.partitionBy("object").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(output, F.col(angle) + F.sum("__turn").over(run)).drop("__none", "__turn")


def clean_elements(df: DataFrame, linear: str = "sma", circular: tuple[str, ...] = ("raan", "mean_anomaly"), width: int = 5, limit: float = 6.0, trim: int = 0) -> DataFrame:
    """``df`` with ``outlier`` and cleaned columns ``<column>_clean``.

    A row is an outlier if ``linear`` is further from the median of the
    ``width`` rows around it than ``limit`` robust sigmas of all such distances
    of its object (0.6745 distance from their median, over their MAD; none if
    that is nought).  There all columns take the median around; that of an
    angle is taken on the unwrapped angle and wrapped to [-180, 180).
    ``trim`` rows go at either end of objects that have more than twice as many.
    """
    w = ordered().rowsBetween(-(width // 2), width - width // 2 - 1)
    out = known(df, linear, *circular)
    for c in circular:
        out = continuous(out, c, f"__u_{c}")
    around = {"__m_": F.percentile(linear, F.lit(0.5)).over(w)} | {f"__m_{c}": F.percentile(f"__u_{c}", F.lit(0.5)).over(w) for c in circular}
    out = out.withColumns(around).withColumn("__d", F.col(linear) - F.col("__m_"))
    out = out.withColumn("__c", middle("__d").over(whole())).withColumn("__a", F.abs(F.col("__d") - F.col("__c")))
    out = out.withColumn("__mad", middle("__a").over(whole()))
    far = F.coalesce((F.col("__mad") > 1e-12) & (0.6745 * F.col("__a") / F.col("__mad") > limit), F.lit(False))
    turned = lambda c: F.pmod(F.col(f"__m_{c}") + 180.0, F.lit(360.0)) - 180.0
    out = out.withColumn("outlier", far)
    out = out.withColumns({f"{linear}_clean": F.when(F.col("outlier"), F.col("__m_")).otherwise(F.col(linear)), **{f"{c}_clean": F.when(F.col("outlier"), turned(c)).otherwise(F.col(c)) for c in circular}})
    if trim:
        out = out.withColumns({"__i": F.row_number().over(ordered()), "__n": F.count("*").over(whole())})
        out = out.where((F.col("__n") <= 2 * trim) | ((F.col("__i") > trim) & (F.col("__i") <= F.col("__n") - trim)))
    return out.select(*df.columns, "outlier", f"{linear}_clean", *(f"{c}_clean" for c in circular))


def rolling_mad(df: DataFrame, value: str = "value", width: int = 11, output: str = "scale") -> DataFrame:
    """1.4826 MAD of the rows around a row; unknown ones (fewer than three values) take the next or last known, those of nought the object's median."""
    out = known(df, value).withColumns({"__i": F.row_number().over(ordered()), "__s": rolling_scale(F.col(value), max(5, width))})
    out = filled(out, {"__s": None}, "__i").withColumn("__f", middle("__s").over(whole()))
    return out.withColumn(output, floored(F.col("__s"), F.col("__f"))).drop("__i", "__s", "__f")


# -- lines ----------------------------------------------------------------------------
def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def _weighted_line(rows: Column) -> Column:
    """Slope and intercept of the least squares of structs ``x``, ``y``, ``w`` (weights of squares); a single time has slope 0."""
    total = lambda f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r))
    means = _let(total(lambda r: r["w"]), lambda s: F.struct((total(lambda r: r["w"] * r["x"]) / s).alias("x"), (total(lambda r: r["w"] * r["y"]) / s).alias("y")))

    def line(m: Column) -> Column:
        xx = total(lambda r: r["w"] * (r["x"] - m["x"]) * (r["x"] - m["x"]))
        xy = total(lambda r: r["w"] * (r["x"] - m["x"]) * (r["y"] - m["y"]))
        return _let(F.coalesce(F.try_divide(xy, xx), F.lit(0.0)), lambda b: F.struct(b.alias("slope"), (m["y"] - b * m["x"]).alias("intercept")))

    return _let(means, line)


def _residuals(rows: Column, fit: Column) -> Column:
    return F.transform(rows, lambda r: r["y"] - fit["slope"] * r["x"] - fit["intercept"])


def _scale(residuals: Column) -> Column:
    """1.4826 MAD."""
    away = lambda v: _let(_middle(v), lambda m: F.sort_array(F.transform(v, lambda x: F.abs(x - m))))
    return 1.4826 * _let(_let(F.sort_array(residuals), away), _middle)


#: What a robust line is.
LINE = StructType([StructField("slope", DoubleType()), StructField("intercept", DoubleType()), StructField("rounds", IntegerType())])


def _reweighted(rows: Column, rounds: int, c: float) -> Column:
    """``LINE`` by least squares, then rounds with weights c / |residual| beyond ``c`` scales, applied to rows (so squared in the sums), until nothing moves.

    A batch of objects at a time, each in NumPy: functions over arrays are
    interpreted by Spark, value by value.  Null: null.
    """

    @F.arrow_udf(LINE)
    def lines(held: pa.Array) -> pa.Array:
        flat, sizes = held.flatten(), held.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        x, y, ends = flat.field("x").to_numpy(), flat.field("y").to_numpy(), np.cumsum(sizes)
        with np.errstate(all="ignore"):
            found = [_huber(x[b - n : b], y[b - n : b], rounds, c) if n else (None, None, None) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.float64(), pa.float64(), pa.int32()), strict=True)], names=LINE.names)

    return lines(rows)


def _huber(x: np.ndarray, y: np.ndarray, rounds: int, c: float) -> tuple[float, float, int]:
    # a running sum adds one value after another, as an aggregate does
    total = lambda v: np.cumsum(v)[-1]

    def line(w: np.ndarray) -> tuple[float, float]:
        s = total(w)
        mx, my = total(w * x) / s, total(w * y) / s
        xx, xy = total(w * (x - mx) * (x - mx)), total(w * (x - mx) * (y - my))
        slope = xy / xx if xx != 0 else 0.0
        return slope, my - slope * mx

    def middle(v: np.ndarray) -> float:
        v, n = np.sort(v), len(v)
        return (v[(n - 1) // 2] + v[n // 2]) / 2

    slope, intercept = line(np.ones(len(x)))
    for k in range(rounds):
        off = y - slope * x - intercept
        scale = 1.4826 * middle(np.abs(off - middle(off)))
        if scale <= 1e-12:
            return float(slope), float(intercept), k
        u = np.abs(off) / scale
        less = c / u
        new = line(np.where(u <= c, 1.0, less * less))
        moved = max(abs(new[0] - slope), abs(new[1] - intercept))
        slope, intercept = new
        if moved < 1e-10:
            return float(slope), float(intercept), k + 1
    return float(slope), float(intercept), rounds


def _series(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Of each object its rows in order as an array of ``x`` (days since the first) and ``y``: 16 bytes a row of one object in a task."""
    own = df.where(F.col(value).isNotNull())
    first = Window.partitionBy(*keys)
    rows = own.withColumn("__x", days(F.col("t") - F.min("t").over(first)))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__x").alias("x"), F.col(value).alias("y")))).alias("rows"))
    return held


def huber_lines(df: DataFrame, value: str = "value", least: int = 3, rounds: int = 50, c: float = 1.345, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """``keys``, ``n``, ``slope`` (a day), ``intercept`` and ``rounds`` of a robust line through each object's values.

    Weights follow the residuals' 1.4826 MAD; rounds end when nothing moves by
    1e-10, or the scale is nought.  Objects of fewer than ``least`` values have
    none.
    """
    held = _series(known(df, value), value, keys).where(F.size("rows") >= max(2, least))
    out = held.withColumn("f", _reweighted(F.col("rows"), rounds, c))
    return out.select(*keys, F.size("rows").alias("n"), F.col("f.slope").alias("slope"), F.col("f.intercept").alias("intercept"), F.col("f.rounds").alias("rounds"))


def huber_residuals(df: DataFrame, value: str = "value", least: int = 3, output: str = "residual") -> DataFrame:
    """``df`` with the distance from the robust line of its object (null where there is none)."""
    fit = huber_lines(df, value, least).select(F.col("object").alias("__o"), "slope", "intercept")
    first = known(df, value).where(F.col(value).isNotNull()).groupBy(F.col("object").alias("__p")).agg(F.min("t").alias("__t0"))
    both = fit.join(first, F.col("__o") == F.col("__p")).select("__o", "__t0", F.col("slope").alias("__s"), F.col("intercept").alias("__i"))
    out = df.join(both, F.col("object") == F.col("__o"), "left")
    away = F.col(value) - F.col("__s") * days(F.col("t") - F.col("__t0")) - F.col("__i")
    return out.select(*df.columns, F.when(~F.isnan(away), away).alias(output))


def secular_rates(df: DataFrame, angle: str, least: int = 3, outlier_sigma: float = 4.0) -> DataFrame:
    """``object``, ``n``, ``rate`` (degrees a day), ``method`` and ``outlier_share`` of an angle's drift.

    The unwrapped angle gets a plain line; where more than one row in a hundred
    is beyond ``outlier_sigma`` robust scales of it, a robust one.
    """
    rows = continuous(known(df, angle), angle, "__u")
    held = _series(rows, "__u", ("object",)).where(F.size("rows") >= least)
    plain = F.transform("rows", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), F.lit(1.0).alias("w")))
    out = held.withColumn("fit", _weighted_line(plain))
    out = out.withColumn("away", _residuals(F.col("rows"), F.col("fit")))
    out = out.withColumn("scale", _scale(F.col("away")))
    spread = lambda v: _let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))
    out = out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(spread(F.col("away"))))
    share = F.when(F.col("scale") > 0, F.size(F.filter("away", lambda x: F.abs(x) > outlier_sigma * F.col("scale"))) / F.size("away")).otherwise(0.0)
    out = out.withColumn("outlier_share", share).withColumn("robust", F.col("outlier_share") > 0.01)
    out = out.withColumn("other", _reweighted(F.when(F.col("robust"), F.col("rows")), 25, 1.345))
    slope = F.when(F.col("robust"), F.col("other.slope")).otherwise(F.col("fit.slope"))
    return out.select("object", F.size("rows").alias("n"), slope.alias("rate"), F.when(F.col("robust"), "huber").otherwise("ols").alias("method"), "outlier_share")
