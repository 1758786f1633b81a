"""Tables as irregular object-time panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object``, ``t`` (microseconds), ``value``, ``category``, ``rec`` of the events table."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("object"), micros("ts").alias("t"), "value", F.col("event_type").alias("category"), F.col("event_id").alias("rec")
    )


#: The same panel in SQL.
EVENT_PANEL = "SELECT user_id AS object, epoch_us(ts) AS t, value, event_type AS category, event_id AS rec FROM events"
