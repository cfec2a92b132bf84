"""Streaming forms: alert suppression, daily bursts, weekly growth, registry upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators.alerts import HOURS


def suppressed_stream(events: DataFrame, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """The batch rule on a stream (key, ts, id): state is the time of each key's last emitted event.

    State expires once the watermark has passed the window. An event later than that compares with the last emitted time.
    """
    window = pd.Timedelta(hours=hours)

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        keep = []
        for ts in rows["ts"]:
            fresh = last is None or ts - last > window
            if fresh:
                last = ts
            keep.append(fresh)
        state.update((last.value // 1000 if last.unit == "ns" else last.as_unit("us").value,))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(emit, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def burst_stream(events: DataFrame, least: int = 3, late: str = "1 day") -> DataFrame:
    """Keys with `least` and more events on a day, once the watermark has passed it."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "key").agg(F.count("*").alias("n"))
    return days.filter(F.col("n") >= least).select("key", F.to_date("window.start").alias("day"), "n")


def weekly_stream(files: DataFrame, late: str = "7 days") -> DataFrame:
    """Files by week from Monday (1970-01-05 was one), once the watermark has passed it."""
    weeks = files.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days")).agg(F.count("*").alias("n"))
    return weeks.select(F.to_date("window.start").alias("week"), "n")
