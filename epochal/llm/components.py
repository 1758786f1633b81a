"""Connected components of an edge list by alternating large and small stars.

Each round replaces edges by stars around smallest neighbours; rounds needed
grow with the logarithm of the longest path.  A vertex with very many edges is
no hot key: smallest neighbours are pre-aggregated, and joins have plain
exchanges on both sides, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import storage

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """``a`` and the smallest of it and its neighbours ``b``.

    Grouped by one more key that follows from ``a``, so that a join by ``a``
    deals both sides anew instead of relying on this grouping.
    """
    return edges.groupBy("a", (F.col("a") % 7).alias("__r")).agg(F.least(F.col("a"), F.min("b")).alias("m")).select("a", "m")


def _joined(edges: DataFrame) -> DataFrame:
    return edges.join(_least(edges).withColumnRenamed("a", "__a"), F.col("a") == F.col("__a")).drop("__a")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex`` and ``component`` (its smallest member) of every vertex of an edge; loops count, nulls don't.

    The edge list must be of integers.  Vertices without edges are not there.
    A round's table goes when that of the next one is written; the last stays,
    as the result is read from it.
    """
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    spark = edges.sparkSession
    path = storage.new_path(spark, "edges")
    now = storage.written(start, "edges", path)
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _joined(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.where("a = b")).distinct()
        small = _joined(large)
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        last, path = path, storage.new_path(spark, "edges")
        now = storage.written(star, "edges", path)
        storage.delete(spark, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component"))
