"""Gap merging on event time, for points and for intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def point_islands(events: DataFrame, key: str, at: str, max_gap_s: int, lateness: str = "10 minutes") -> DataFrame:
    """``(key, start, end, n)``: events of a key at most ``max_gap_s`` apart, as sessions; emitted when the watermark passes.

    A session window closes strictly before its gap, so one second is added.
    """
    window = F.session_window(at, f"{max_gap_s + 1} seconds")
    return events.withWatermark(at, lateness).groupBy(key, window).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def interval_islands(intervals: DataFrame, key: str, start: str, end: str, max_gap_s: int = 0, lateness: str = "10 minutes") -> DataFrame:
    """``(key, start, end, n)``: overlapping or near intervals of a key merged across micro-batches.

    A key's open islands are its state; one is emitted when the watermark has passed its end and gap. An interval that
    comes later than the lateness allows is dropped by the watermark.
    """
    gap = pd.Timedelta(seconds=max_gap_s)

    def merge(key_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = [(pd.Timestamp(a), pd.Timestamp(b), int(n)) for a, b, n in held]
        for pdf in batches:
            rows += [(a, b, 1) for a, b in zip(pdf[start], pdf[end]) if pd.notna(a) and pd.notna(b) and b > a]
        merged: list[list] = []
        for a, b, n in sorted(rows):
            if merged and a - merged[-1][1] <= gap:
                merged[-1][1] = max(merged[-1][1], b)
                merged[-1][2] += n
            else:
                merged.append([a, b, n])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        done = [m for m in merged if m[1] + gap < mark]
        left = [m for m in merged if m[1] + gap >= mark]
        if left:
            state.update(([m[0].isoformat() for m in left], [m[1].isoformat() for m in left], [m[2] for m in left]))
            state.setTimeoutTimestamp(max(int((left[0][1] + gap).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame({key: [key_[0]] * len(done), "start": [m[0] for m in done], "end": [m[1] for m in done], "n": [m[2] for m in done]})

    kind = intervals.schema[key].dataType.simpleString()
    rows = intervals.select(key, F.col(start).cast("timestamp").alias(start), F.col(end).cast("timestamp").alias(end))
    return rows.withWatermark(end, lateness).groupBy(key).applyInPandasWithState(merge, f"`{key}` {kind}, start timestamp, end timestamp, n long", "a array<string>, b array<string>, n array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
