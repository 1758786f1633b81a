"""Window operators over irregular series, one object at a time.

All specifications partition by the object and order by (t, rec), so a chain
of them shares one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.tables import DAY



def ordered():
    """Rows of an object in time, ties by record number."""
    return Window.partitionBy("object").orderBy("t", "rec")


def whole():
    return Window.partitionBy("object")


def days(micros: Column) -> Column:
    return micros / F.lit(float(DAY))


def centred(width: int):
    """Rows around a row: odd widths are symmetric, even ones reach one row less ahead."""
    return ordered().rowsBetween(-(width // 2), width - width // 2 - 1)


def trailing(span: int):
    """Rows of the last ``span`` microseconds, the row itself included, the far end left out."""
    return Window.partitionBy("object").orderBy("t").rangeBetween(-span + 1, 0)


def around(span: int):
    """Rows within ``span`` microseconds on either side, both ends included."""
    return Window.partitionBy("object").orderBy("t").rangeBetween(-span, span)


def differences(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``dt_days``, ``d1`` and ``d2``: steps of time and value, and the step of the step."""
    d1 = F.col(value) - F.lag(value).over(ordered())
    out = df.withColumns({"dt_days": days(F.col("t") - F.lag("t").over(ordered())), "d1": d1})
    return out.withColumn("d2", F.col("d1") - F.lag("d1").over(ordered()))


def derivative(df: DataFrame, value: str = "value", output: str = "rate") -> DataFrame:
    """Change a day since the row before; null where no time passed; the first row has the second's."""
    step = F.col("t") - F.lag("t").over(ordered())
    rate = F.when(step != 0, (F.col(value) - F.lag(value).over(ordered())) / days(step))
    out = df.withColumn("__r", rate).withColumn("__n", F.row_number().over(ordered()))
    return out.withColumn(output, F.when(F.col("__n") == 1, F.lead("__r").over(ordered())).otherwise(F.col("__r"))).drop("__r", "__n")


def central_slope(df: DataFrame, value: str = "value", output: str = "slope") -> DataFrame:
    """Change a day between the neighbours of a row, one-sided at the ends; null for objects of fewer than three rows."""
    before, after = F.coalesce(F.lag("t").over(ordered()), F.col("t")), F.coalesce(F.lead("t").over(ordered()), F.col("t"))
    low, high = F.coalesce(F.lag(value).over(ordered()), F.col(value)), F.coalesce(F.lead(value).over(ordered()), F.col(value))
    slope = F.when((F.count("*").over(whole()) >= 3) & (after > before), (high - low) / days(after - before))
    return df.withColumn(output, slope)


def rolling_median(df: DataFrame, width: int, value: str = "value", output: str = "median", least: int = 1) -> DataFrame:
    w = centred(width)
    return df.withColumn(output, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def rolling_quantiles(df: DataFrame, span: int, value: str = "value", least: int = 3) -> DataFrame:
    """``q10``, ``q50`` and ``q90`` of the last ``span`` microseconds."""
    w = trailing(span)
    some = F.count(value).over(w) >= least
    return df.withColumns({f"q{int(q * 100)}": F.when(some, F.percentile(value, F.lit(q)).over(w)) for q in (0.1, 0.5, 0.9)})


def adjacent_line_difference(df: DataFrame, width: int = 9, value: str = "value", output: str = "jump") -> DataFrame:
    """Difference at a row between the lines fitted to the rows before and to the rows from it on; null at the ends."""
    x = days(F.col("t") - F.min("t").over(whole()))
    out = df.withColumn("__x", x)
    back, ahead = ordered().rowsBetween(-width, -1), ordered().rowsBetween(0, width - 1)
    at = {}
    for name, w in (("b", back), ("a", ahead)):
        full = F.count(value).over(w) == width
        at[name] = F.when(full, F.regr_intercept(value, "__x").over(w) + F.regr_slope(value, "__x").over(w) * F.col("__x"))
    return out.withColumn(output, at["a"] - at["b"]).drop("__x")


def peaks(df: DataFrame, value: str = "value", least: float = 0.0, width: int = 5) -> DataFrame:
    """Rows at or beyond both neighbours, up or down, that stand out from the rolling median; ends are none."""
    before, after, v = F.lag(value).over(ordered()), F.lead(value).over(ordered()), F.col(value)
    w = centred(width)
    prominence = F.abs(v - F.percentile(value, F.lit(0.5)).over(w))
    high, low = (v >= before) & (v >= after), (v <= before) & (v <= after)
    return df.withColumns({"prominence": prominence, "peak": F.coalesce((high | low) & (prominence >= least), F.lit(False))})


def runs(df: DataFrame, state: Column, output: str = "run") -> DataFrame:
    """Numbers of the maximal runs of equal state, from 1."""
    later = F.lag(F.lit(1)).over(ordered()).isNotNull()
    changed = F.when(later & state.eqNullSafe(F.lag(state).over(ordered())), 0).otherwise(1)
    return df.withColumn("__c", changed).withColumn(output, F.sum("__c").over(ordered())).drop("__c")


def bridged(df: DataFrame, mask: Column, gap: int, output: str = "mask") -> DataFrame:
    """Mask with false runs of up to ``gap`` rows between two true ones filled."""
    out = runs(df.withColumn("__m", mask), F.col("__m"), "__run")
    by_run = Window.partitionBy("object", "__run")
    out = out.withColumn("__size", F.count("*").over(by_run))
    inner = (F.col("__run") > 1) & (F.col("__run") < F.max("__run").over(whole()))
    return out.withColumn(output, F.col("__m") | (inner & (F.col("__size") <= gap))).drop("__m", "__run", "__size")


def robust_z(df: DataFrame, value: str = "value", output: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD over the object; null where the MAD is zero.

    Medians are two aggregations joined back, not windows over whole objects.
    """
    mid = df.groupBy("object").agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    out = df.join(mid, "object")
    mad = out.groupBy("object").agg(F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)).alias("__mad"))
    out = out.join(mad, "object")
    return out.withColumn(output, F.when(F.col("__mad") > 0, 0.6745 * (F.col(value) - F.col("__m")) / F.col("__mad"))).drop("__m", "__mad")


def cadence(df: DataFrame) -> DataFrame:
    """Of each object: median, spread, largest and 95th step in hours, and gaps of more than three medians."""
    steps = df.withColumn("dt", (F.col("t") - F.lag("t").over(ordered())) / 3.6e9).where("dt IS NOT NULL")
    mid = steps.groupBy("object").agg(F.percentile("dt", F.lit(0.5)).alias("m"))
    return steps.join(mid, "object").groupBy("object").agg(
        F.count("*").alias("n_steps"),
        F.first("m").alias("median_h"),
        F.percentile(F.abs(F.col("dt") - F.col("m")), F.lit(0.5)).alias("mad_h"),
        F.max("dt").alias("max_h"),
        F.percentile("dt", F.lit(0.95)).alias("p95_h"),
        (F.stddev_pop("dt") / F.first("m")).alias("cv"),
        F.sum((F.col("dt") > 3 * F.col("m")).cast("long")).alias("n_gaps"),
    )
