"""Quality control with reason codes.

All rules are judged in one pass: a row's reasons are one column, so accepted
rows, rejected rows and counts a cause come from the same scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def reject_reasons(df: DataFrame, rules: Mapping[str, Column], output: str = "reasons") -> DataFrame:
    """Adds the names of all rules that are true, joined by ``;`` (empty: accepted); a null rule counts as not true."""
    return df.withColumn(output, F.concat_ws(";", *(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def element_rules(max_sma: float) -> dict[str, Column]:
    """Rules for orbital element rows."""
    bad = lambda c: ~finite(F.col(c))
    return {
        "invalid_timestamp": F.col("t").isNull(),
        "invalid_ecc_bounds": bad("ecc") | (F.col("ecc") < 0) | (F.col("ecc") >= 1),
        "invalid_inc_bounds": bad("inc") | (F.col("inc") < 0) | (F.col("inc") > 180),
        "invalid_mean_motion": bad("mean_motion") | (F.col("mean_motion") <= 0),
        "invalid_sma": bad("sma") | (F.col("sma") <= 0),
        "sma_above_max": finite(F.col("sma")) & (F.col("sma") > max_sma),
        "nonfinite_raan": bad("raan"),
        "nonfinite_aop": bad("aop"),
        "nonfinite_mean_anomaly": bad("mean_anomaly"),
    }


def sound_elements(max_sma: float) -> Column:
    """Whether none of :func:`element_rules` is true, without telling which: a few comparisons (NaN is above all numbers, null is no yes)."""
    below = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    ecc, inc, sma = F.col("ecc"), F.col("inc"), F.col("sma")
    shape = (ecc >= 0) & (ecc < 1) & (inc >= 0) & (inc <= 180) & (sma > 0) & (sma <= max_sma) & (sma < float("inf"))
    return shape & F.col("t").isNotNull() & (F.col("mean_motion") > 0) & below("mean_motion") & below("raan") & below("aop") & below("mean_anomaly")


def counts_by_cause(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    return df.select(F.explode(F.split(reasons, ";")).alias("cause")).where("cause <> ''").groupBy("cause").agg(F.count("*").alias("n"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total for a stable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sanitised(df: DataFrame, core: list[str], targets: Mapping[str, list[str]]) -> DataFrame:
    """Rows whose ``core`` columns are all finite, with masked targets zeroed.

    ``targets`` names a mask column and its target columns: the mask is 1 only
    where all of them are finite (times the row's own mask, if the table has
    one), else 0; where it is not above one half its targets are 0.
    """
    out = df
    for c in core:
        out = out.where(finite(F.col(c)))
    for mask, columns in targets.items():
        good = F.lit(True)
        for c in columns:
            good = good & finite(F.col(c))
        own = F.col(mask).cast("double") if mask in df.columns else F.lit(1.0)
        out = out.withColumn(mask, F.when(good & finite(own), own).otherwise(0.0))
        out = out.withColumns({c: F.when(F.col(mask) > 0.5, F.col(c)).otherwise(0.0) for c in columns})
    return out
