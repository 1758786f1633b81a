"""Streams whose rows come out of order."""

import datetime as dt
import random

from epochal.streaming import windows


def test_states_are_folded_in_event_time(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    states = ["a"] * 4 + ["b", "a", "b"] + ["b"] * 4 + ["c"] * 2 + ["b"] + ["c"] * 4
    rows = [(1, start + dt.timedelta(hours=n), s) for n, s in enumerate(states)]
    random.Random(3).shuffle(rows)
    source, out = tmp_path / "in", tmp_path / "out"
    kind = "object long, ts timestamp, state string"
    spark.createDataFrame(rows[:10], kind).repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(kind).parquet(str(source))

    def drain():
        query = windows.debounced_states(stream, time="ts", late="2 days").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    drain()
    spark.createDataFrame(rows[10:], kind).repartition(3).write.mode("append").parquet(str(source))
    drain()
    late = [(1, start + dt.timedelta(days=9), "c"), (2, start + dt.timedelta(days=9), "z")]
    spark.createDataFrame(late, kind).write.mode("append").parquet(str(source))
    drain()
    drain()
    spark.createDataFrame([(2, start + dt.timedelta(days=30), "z")], kind).write.mode("append").parquet(str(source))
    drain()
    got = [(r.from_state, r.to_state) for r in spark.read.parquet(str(out)).where("object = 1").collect()]
    assert sorted(got, key=str) == [("a", "b"), ("b", "c"), (None, "a")]
