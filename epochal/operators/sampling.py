"""Samples and splits that give the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.shared import checkpointed

#: An order column (an evenly spread whole number below ``SPREAD``) is cut into so many ranges.
SPREAD = 1_000_003
RANGES = 512


def stratified(df: DataFrame, stratum: str, order: str, key: str, fraction: float, least: int = 1) -> DataFrame:
    """The first rows of each stratum by ``order``, then ``key``: a fraction of them, rounded up, and ``least`` at least.

    Strata may be few and large: rows are ranked within ranges of the order
    only, and counts of ranges (a small table) say where each range begins.
    """
    cut = df.withColumn("__range", F.floor(F.col(order) * RANGES / SPREAD))
    counts = cut.groupBy(stratum, "__range").agg(F.count("*").alias("__c"))
    running = Window.partitionBy(stratum).orderBy("__range")
    starts = counts.withColumns({"__first": F.sum("__c").over(running) - F.col("__c"), "__n": F.sum("__c").over(Window.partitionBy(stratum))})
    starts = starts.withColumn("__want", F.greatest(F.lit(least), F.ceil(F.col("__n") * fraction))).where("__first < __want")
    starts = starts.select(F.col(stratum).alias("__s"), F.col("__range").alias("__r"), "__first", "__want")
    rows = cut.join(starts, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    rank = F.row_number().over(Window.partitionBy("__s", "__r").orderBy(order, key))
    return rows.withColumn("__k", rank + F.col("__first")).where("__k <= __want").select(df.columns)


def split(df: DataFrame, by: Column, shares: dict[str, int], name: str = "split") -> DataFrame:
    """Adds a split: ``by`` (a whole number that spreads evenly; the same for all rows of an object) modulo the sum of shares."""
    place = F.pmod(by, F.lit(sum(shares.values())))
    out, at = F.lit(None).cast("string"), sum(shares.values())
    for part, share in reversed(shares.items()):
        out = F.when(place < at, part).otherwise(out)
        at -= share
    return df.withColumn(name, out)


def leave_one_out(df: DataFrame, totals: dict[str, str], key: str = "object") -> DataFrame:
    """Of each object: count of the rows of all others, and sums of columns (name: column) over them.

    A complement is the whole less the object, so nothing is repeated per
    object.  Null and NaN values count 0 (``<name>_known`` counts the others'
    values that are neither); a sum over no values is null.  Rows without an
    object are an object of their own.
    """
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c))
    parts = [x for n, c in totals.items() for x in (F.coalesce(F.sum(known(c)), F.lit(0)).alias(f"__{n}"), F.count(known(c)).alias(f"__{n}_known"))]
    own = df.groupBy(key).agg(F.count("*").alias("__n"), *parts)
    names = ["n", *(x for n in totals for x in (n, f"{n}_known"))]
    whole = own.agg(*(F.sum(f"__{n}").alias(f"__w_{n}") for n in names))
    rest = lambda n: F.col(f"__w_{n}") - F.col(f"__{n}")
    values = [x for n in totals for x in (F.when(rest(f"{n}_known") > 0, rest(n)).alias(n), rest(f"{n}_known").alias(f"{n}_known"))]
    return own.join(F.broadcast(whole)).select(key, rest("n").alias("n_others"), *values)


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order they first come, numbered from 0 (values, not rows, are numbered); no task sees them all."""
    first = df.groupBy(column).agg(F.min(order).alias("first"))
    return numbered(first, [F.col("first"), F.col(column)], "position")


def numbered(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """``df`` with row numbers from 0 in a total order: ranges are numbered each from the count of those before (one row a range)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__c"))
    starts = counts.select(F.col("__part").alias("__p"), (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(starts, F.col("__part") == F.col("__p")).withColumn(output, F.col("__first") + within - 1).drop("__part", "__p", "__first")
