"""Structured Streaming over event and frame tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events with an event time that takes watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Of a stream, sessions are given out, and their state goes, once the watermark has passed them."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def frame_difference(frames: DataFrame, late: str = "1 minute") -> DataFrame:
    """Stream of (media_id, frame_idx, ts, data): mean absolute change since the clip's frame before.

    Frames wait in the state until the watermark has passed their time, and are then taken
    in order, so a frame that comes late, but within `late`, is compared in its place. The
    state is a clip's last frame and those that wait.
    """
    import numpy as np

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], list(zip(*state.get[1:]))) if state.exists else (None, [])
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [(int(t.timestamp() * 1e6), int(k), bytes(x)) for t, k, x in zip(pdf["ts"], pdf["frame_idx"], pdf["data"])]
        passed = state.getCurrentWatermarkMs() * 1000
        rows, later = [], []
        for t, k, x in sorted(waiting):
            if t > passed:
                later.append((t, k, x))
                continue
            if last is not None:
                rows.append((key[0], k, float(np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(last, np.uint8)).mean())))
            last = x
        state.update((last, [t for t, _, _ in later], [k for _, k, _ in later], [x for _, _, x in later]))
        if later:
            state.setTimeoutTimestamp(max(later[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["media_id", "frame_idx", "change"])

    kept = "last binary, ts array<long>, frame_idx array<long>, data array<binary>"
    return frames.withWatermark("ts", late).groupBy("media_id").applyInPandasWithState(step, "media_id string, frame_idx long, change double", kept, "append", "EventTimeTimeout")
