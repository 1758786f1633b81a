"""Daily driver tables (solar and geomagnetic indices) from CSV, gap-filled over a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def row_mean(*columns: Column) -> Column:
    """Mean of what is not null; null if all are."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    """``date``, ``kp``, ``ap``, ``f107``: Kp and Ap from the daily columns, else from the eight three-hourly ones.

    Rows without a readable date go; unreadable numbers are null.
    """
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    kp = F.coalesce(number("KP_SUM") / 80, row_mean(*(number(f"KP{i}") for i in range(1, 9))) / 10)
    ap = F.coalesce(number("AP_AVG"), row_mean(*(number(f"AP{i}") for i in range(1, 9))))
    clip = lambda x, high: F.greatest(F.least(x, F.lit(high)), F.lit(0.0))
    return raw.select(F.col("DATE").try_cast("date").alias("date"), clip(kp, 9.0).alias("kp"), clip(ap, 400.0).alias("ap"), number("F10.7_OBS").alias("f107")).where("date IS NOT NULL")


def merged(tables: list[DataFrame], start: str, end: str) -> DataFrame:
    """A row a day of the calendar with every table's columns, each filled along lines and level at the ends.

    A calendar has few rows; one task orders it, whatever the data's size.
    """
    out = tables[0].sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    for t in tables:
        out = out.join(t.groupBy("date").agg(*(F.avg(c).alias(c) for c in t.columns if c != "date")), "date", "left")
    w = Window.orderBy("date")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    day = F.datediff("date", F.lit("1970-01-01"))
    fields = [c for c in out.columns if c != "date"]
    for c in fields:
        known = F.when(F.col(c).isNotNull(), F.struct(day.alias("d"), F.col(c).alias("v")))
        out = out.withColumns({f"__b_{c}": F.last(known, True).over(back), f"__a_{c}": F.first(known, True).over(ahead)})
    for c in fields:
        b, a = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        line = b["v"] + (a["v"] - b["v"]) * (day - b["d"]) / F.greatest(a["d"] - b["d"], F.lit(1))
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)))
    return out.select("date", *fields)
