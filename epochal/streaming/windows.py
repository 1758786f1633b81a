"""Streaming variants of the roll-ups (an extension: the batch operators have bounded inputs)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_occupancy(stream: DataFrame, width: str = "7 days", late: str = "2 days", time: str = "ts", shell: str = "shell", key: str = "object") -> DataFrame:
    """Counts per (time bin, shell) of a stream; rows later than ``late`` behind the watermark are left out."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), shell)
        .agg(F.count("*").alias("n_records"), F.approx_count_distinct(key).alias("n_objects"), F.avg("value").alias("centroid"))
        .select(F.col("w.start").alias("time_bin"), shell, "n_records", "n_objects", "centroid")
    )


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day", time: str = "ts", key: str = "object") -> DataFrame:
    """Bursts of an object's rows with no pause longer than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(key, F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "n", "top")


def debounced_states(stream: DataFrame, least: int = 3, key: str = "object", state: str = "state", time: str | None = None, late: str = "1 day") -> DataFrame:
    """Changes of an object's state, reported once a new state has come ``least`` times in a row.

    State kept per object: the settled state, the one on trial and its count.
    With a ``time`` column rows are folded in the order of event time: they
    wait until the watermark (``late`` behind) has passed them, or an event
    time timeout says so, so shuffling doesn't change the result; rows later
    than the watermark are left out.  Without one they count as they come.
    """

    def fold(name, values, settled, trial, count, out):
        for value in values:
            if value == settled:
                trial, count = None, 0
                continue
            count = count + 1 if value == trial else 1
            trial = value
            if count >= least:
                out.append((name, settled, value))
                settled, trial, count = value, None, 0
        return settled, trial, count

    def step(name: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        settled, trial, count, times, waiting = kept.get if kept.exists else (None, None, 0, [], [])
        pending = list(zip(times, waiting, strict=True))
        out: list[tuple] = []
        passed = None if time is None else kept.getCurrentWatermarkMs()
        for batch in batches:
            if time is None:
                settled, trial, count = fold(name[0], batch[state], settled, trial, count, out)
                continue
            stamps = (batch[time].astype("datetime64[us]").astype("int64") // 1000).tolist()
            pending += [(t, v) for t, v in zip(stamps, batch[state], strict=True) if t > passed]
        if time is not None:
            ready = sorted(p for p in pending if p[0] <= passed)
            pending = sorted(p for p in pending if p[0] > passed)
            settled, trial, count = fold(name[0], [v for _, v in ready], settled, trial, count, out)
            if pending:
                kept.setTimeoutTimestamp(pending[0][0] + 1)
        kept.update((settled, trial, count, [t for t, _ in pending], [v for _, v in pending]))
        yield pd.DataFrame(out, columns=[key, "from_state", "to_state"])

    rows = stream if time is None else stream.withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} long, from_state string, to_state string", "settled string, trial string, n int, times array<long>, waiting array<string>", "append", "NoTimeout" if time is None else "EventTimeTimeout"
    )
