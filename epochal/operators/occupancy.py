"""Occupancy of value bins over epoch-anchored time bins, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.tables import DAY


def time_bin(width: int, t: str = "t") -> Column:
    """Start of the bin of ``width`` microseconds, counted from 1970."""
    return F.floor(F.col(t) / width) * width


def cut(value: Column, edges: Sequence[float], first_label: float | None = None) -> Column:
    """Label of the right-closed bin, the lowest edge included; ``nan`` outside, which stays a group."""
    out = F.when(value.isNull() | F.isnan(value), F.lit("nan"))
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (value > a) & (value <= b) if n else (value >= a) & (value <= b)
        out = out.when(inside, F.lit(f"({a if n or first_label is None else first_label}, {b}]"))
    return out.otherwise(F.lit("nan"))


def occupancy(df: DataFrame, width: int = 7 * DAY) -> DataFrame:
    """Per (time bin, shell): counts, spread, median, deviation; shares of the bin; drift and replenishment since the shell's last bin."""
    agg = df.groupBy(time_bin(width).alias("time_bin"), "shell").agg(
        F.count("*").alias("n_records"),
        F.count_distinct("object").alias("n_objects"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.stddev_samp("value").alias("std"),
        F.avg("value").alias("centroid"),
    )
    in_bin, in_shell = Window.partitionBy("time_bin"), Window.partitionBy("shell").orderBy("time_bin")
    days = (F.col("time_bin") - F.lag("time_bin").over(in_shell)) / F.lit(float(DAY))
    return agg.withColumns(
        {
            "record_share": F.col("n_records") / F.sum("n_records").over(in_bin),
            "object_share": F.col("n_objects") / F.sum("n_objects").over(in_bin),
            "drift_per_day": (F.col("centroid") - F.lag("centroid").over(in_shell)) / days,
            "replenishment": F.greatest(F.col("n_objects") - F.lag("n_objects").over(in_shell), F.lit(0)),
            "age_days": (F.col("time_bin") - F.min("time_bin").over(Window.partitionBy("shell"))) / F.lit(float(DAY)),
        }
    )


def transitions(df: DataFrame) -> DataFrame:
    """Changes of shell of each object from record to record: one row a change."""
    w = Window.partitionBy("object").orderBy("t", "rec")
    out = df.withColumns({"from_shell": F.lag("shell").over(w), "from_value": F.lag("value").over(w)})
    return out.where("from_shell IS NOT NULL AND from_shell <> shell").select("object", "rec", "t", "from_shell", F.col("shell").alias("to_shell"), (F.col("value") - F.col("from_value")).alias("change"))


def direction(change: Column, threshold: float) -> Column:
    return F.when(change.isNull() | F.isnan(change), "unknown").when(change > threshold, "upward").when(change < -threshold, "downward").otherwise("lateral")


def with_empty_bins(agg: DataFrame, labels: Sequence[str], key: str = "time_bin", bin_column: str = "shell", count: str = "n_records") -> DataFrame:
    """Every label for every key, zero where there is none: keys are exploded by the fixed list of labels."""
    every = agg.select(key).distinct().withColumn(bin_column, F.explode(F.array(*map(F.lit, labels))))
    return every.join(agg, [key, bin_column], "left").withColumn(count, F.coalesce(count, F.lit(0)))
