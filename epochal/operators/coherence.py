"""How groups of objects keep together: drift rates, tracking and phase errors, spread, and distances of draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions import angles
from epochal.operators.series import days, ordered


def drift_rates(df: DataFrame, *series: str) -> DataFrame:
    """Of each object the mean drift (degrees a day) of angles: distance of both ends of the unwrapped series by their time.

    It is the sum of the steps between records; fewer than two records or no time between them: 0.
    """
    step = {f"__{c}": angles.wrap_180(F.round(F.col(c) - F.lag(c).over(ordered()), 9)) for c in series}
    span = days(F.max("t") - F.min("t"))
    rate = lambda c: F.when(span > 0, F.coalesce(F.sum(f"__{c}"), F.lit(0.0)) / span).otherwise(0.0)
    return df.withColumns(step).groupBy("object").agg(F.count("*").alias("n"), *(rate(c).alias(f"{c}_per_day") for c in series))


def drift_loss(rates: DataFrame, group: str, node: str, phase: str, kappa: float = 1.0) -> DataFrame:
    """Of each group: variance of its members' node drifts and ``kappa`` times that of their phase drifts; one member: 0."""
    return rates.groupBy(group).agg(F.count("*").alias("members"), (F.var_pop(node) + kappa * F.var_pop(phase)).alias("loss"))


def tracking_losses(df: DataFrame, group: str, sma: str, longitude: str, sigma_a: float = 5.0, sigma_l: float = 0.05) -> DataFrame:
    """Mean squared errors of semi-major axis (km) and of mean longitude (radians, on the circle), by their scales, against ``a_ref`` and ``l_ref``."""
    error = F.col(longitude) - F.col("l_ref")
    on_circle = F.atan2(F.sin(error), F.cos(error))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.pow((F.col(sma) - F.col("a_ref")) / sigma_a, 2)).alias("sma_loss"), F.avg(F.pow(on_circle / sigma_l, 2)).alias("phase_loss"))


def spread(df: DataFrame, group: str, checkpoint: str, member: str, sma: str, *turning: str) -> DataFrame:
    """Of each group and checkpoint: members, mean and trace of the covariance of ``sma`` and of angles (radians) as seen from the first member."""
    first = df.groupBy(group, checkpoint).agg(F.min_by(F.struct(*turning), member).alias("__first"))
    rows = df.join(first, [group, checkpoint])
    near = {c: F.atan2(F.sin(F.col(c) - F.col(f"__first.{c}")), F.cos(F.col(c) - F.col(f"__first.{c}"))) + F.col(f"__first.{c}") for c in turning}
    rows = rows.withColumns(near)
    trace = F.var_samp(sma)
    for c in turning:
        trace = trace + F.var_samp(c)
    return rows.groupBy(group, checkpoint).agg(F.count("*").alias("members"), F.avg(sma).alias("mean_sma"), trace.alias("trace"))


def jensen_shannon(draws: DataFrame, edges: int = 80, group: str = "object", value: str = "x") -> DataFrame:
    """``a``, ``b``, ``jsd``: square root of the divergence (base 2) of each pair of groups, over a histogram of both.

    The bins of a pair span the values of both, so each group's values are
    counted once a pair: work is draws times groups, and a pair is one row.
    Counts are not smoothed: a bin that one side alone fills counts in full.
    """
    bins = edges - 1
    own = draws.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    ends = own.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    a = ends.select(F.col(group).alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    b = ends.select(F.col(group).alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.least("la", "lb").alias("low"), F.greatest("ha", "hb").alias("high"))
    sides = pairs.select("*", F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(0).alias("side")), F.struct(F.col("b").alias("g"), F.lit(1).alias("side")))).alias("s")).select("a", "b", "low", "high", "s.*")
    rows = sides.join(own.select(F.col(group).alias("g"), F.col(value).alias("x")), "g")
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy("a", "b", place.alias("bin")).agg(F.sum((F.col("side") == 0).cast("double")).alias("p"), F.sum((F.col("side") == 1).cast("double")).alias("q"))
    total = Window.partitionBy("a", "b")
    scaled = counts.withColumns({"p": F.col("p") / F.sum("p").over(total), "q": F.col("q") / F.sum("q").over(total)})
    kl = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    mid = (F.col("p") + F.col("q")) / 2
    return scaled.groupBy("a", "b").agg(F.sqrt(F.greatest(F.sum(kl(F.col("p"), mid) + kl(F.col("q"), mid)) / 2, F.lit(0.0))).alias("jsd"))


def line_residuals(df: DataFrame, value: str = "value", least: int = 3, output: str = "residual") -> DataFrame:
    """Difference from each object's least-squares line over time; null for objects of fewer than ``least`` values.

    Rows without an object are one of their own; a null or NaN value has no
    residual and takes no part in the line.
    """
    df = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    first = df.groupBy(F.col("object").alias("__o")).agg(F.min("t").alias("__t0"))
    rows = df.join(first, F.col("object").eqNullSafe(F.col("__o"))).withColumn("__x", days(F.col("t") - F.col("__t0")))
    fit = rows.groupBy(F.col("object").alias("__f")).agg(F.regr_slope(value, "__x").alias("__s"), F.regr_intercept(value, "__x").alias("__i"), F.count(value).alias("__n"))
    out = rows.join(fit, F.col("object").eqNullSafe(F.col("__f")))
    return out.select(*df.columns, F.when(F.col("__n") >= least, F.col(value) - F.col("__i") - F.col("__s") * F.col("__x")).alias(output))


def normalised(df: DataFrame, mode: str, value: str = "value", output: str = "y") -> DataFrame:
    """``raw``, ``detrended`` (line over row numbers), ``zscored`` (population deviation; a constant is centred) or ``differenced`` values of each object.

    Rows without an object are one of their own; NaN counts as null, which
    stays null and takes no part in means, deviations and lines.
    """
    df = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    if mode == "raw":
        return df.withColumn(output, F.col(value))
    if mode == "differenced":
        return df.withColumn(output, F.col(value) - F.lag(value).over(ordered())).where(F.col(output).isNotNull())
    if mode == "zscored":
        fit = df.groupBy(F.col("object").alias("__f")).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
        own = (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
        return df.join(fit, F.col("object").eqNullSafe(F.col("__f"))).withColumn(output, own).drop("__f", "__m", "__s")
    if mode == "detrended":
        rows = df.withColumn("__i", (F.row_number().over(ordered()) - 1).cast("double"))
        fit = rows.groupBy(F.col("object").alias("__f")).agg(F.regr_slope(value, "__i").alias("__s"), F.regr_intercept(value, "__i").alias("__b"))
        own = F.coalesce(F.col(value) - F.col("__b") - F.col("__s") * F.col("__i"), F.col(value))
        return rows.join(fit, F.col("object").eqNullSafe(F.col("__f"))).withColumn(output, own).drop("__f", "__s", "__b", "__i")
    raise ValueError(f"unknown mode {mode!r}")


def range_means(df: DataFrame, ranges: DataFrame, value: str = "value") -> DataFrame:
    """``ranges`` (``object``, ``start``, ``stop`` as row numbers from 0, half open) with ``mean`` of the values in them, by running sums.

    Two rows of running sums a range are looked up; ranges beyond the ends are
    cut; null values don't count, and a range without any has null.
    """
    run = ordered().rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(value).isNotNull() & ~F.isnan(value)
    sums = df.select("object", F.row_number().over(ordered()).alias("i"), F.sum(F.when(known, F.col(value)).otherwise(0.0)).over(run).alias("s"), F.sum(known.cast("long")).over(run).alias("c"))
    size = df.groupBy(F.col("object").alias("__o")).agg(F.count("*").alias("__n"))
    cut = lambda c: F.greatest(F.least(F.col(c), F.col("__n")), F.lit(0))
    asked = ranges.join(size, F.col("object") == F.col("__o"), "left").withColumns({"__a": cut("start"), "__b": cut("stop")})
    for side in ("a", "b"):
        own = sums.select(F.col("object").alias(f"__o{side}"), F.col("i").alias(f"__i{side}"), F.col("s").alias(f"__s{side}"), F.col("c").alias(f"__c{side}"))
        asked = asked.join(own, (F.col("object") == F.col(f"__o{side}")) & (F.col(f"__{side}") == F.col(f"__i{side}")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = zero("__cb") - zero("__ca")
    return asked.select(*ranges.columns, F.when(n > 0, (zero("__sb") - zero("__sa")) / n).alias("mean"))


def spread_rows(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each object, evenly by row number, both ends included."""
    n = F.count("*").over(Window.partitionBy("object"))
    rows = df.withColumns({"__i": F.row_number().over(ordered()) - 1, "__n": n})
    # the k-th of them is at floor(k (n - 1) / (most - 1)); a row is taken if some k falls on it
    k = F.ceil(F.col("__i") * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    taken = F.floor(k * (F.col("__n") - 1) / max(most - 1, 1)) == F.col("__i")
    return rows.where((F.col("__n") <= most) | taken).drop("__i", "__n")

