"""Keyed state with event-time timers: the history of each clip's frames in a stream.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FrameHistory(StatefulProcessor):
    """Frames wait in a map until a timer at their time says that the watermark has passed them.

    They are then taken in order, and each gives the whole mean of itself and the `length`
    frames before it, which a list keeps, newest last. A frame that comes twice while it
    waits counts once. A clip that has been quiet for `keep` milliseconds of event time is
    forgotten by a timer of its own; one that a later frame has overtaken does nothing.
    """

    def __init__(self, length: int, keep: int) -> None:
        self.length, self.keep = length, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, frame_idx long", "data binary")
        self.before = handle.getListState("before", "data binary")
        self.forget = handle.getValueState("forget", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, frame_idx, data in zip(pdf["ts"], pdf["frame_idx"], pdf["data"]):
                at = int(ts.timestamp() * 1000)
                self.waiting.updateValue((at, int(frame_idx)), (bytes(data),))
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due = sorted(k for k in self.waiting.keys() if k[0] <= min(now, passed))
        if not due:
            if self.forget.exists() and self.forget.get()[0] <= now:
                self.before.clear()
                self.forget.clear()
            return
        before = [x[0] for x in self.before.get()] if self.before.exists() else []
        rows = []
        for k in due:
            data = self.waiting.getValue(k)[0]
            self.waiting.removeKey(k)
            seen = np.stack([np.frombuffer(x, np.uint8) for x in [*before, data]])
            rows.append((key[0], k[1], (seen.sum(axis=0, dtype=np.int64) // len(seen)).astype(np.uint8).tobytes()))
            before = [*before, data][-self.length :] if self.length else []
        if before:
            self.before.put([(x,) for x in before])
        self.forget.update((due[-1][0] + self.keep,))
        self.handle.registerTimer(due[-1][0] + self.keep)
        yield pd.DataFrame(rows, columns=["media_id", "frame_idx", "data"])

    def close(self) -> None:
        pass


def frame_history(frames: DataFrame, length: int, late: str = "1 minute", keep: int = 3_600_000) -> DataFrame:
    """Stream of (media_id, frame_idx, ts, data): for each frame, once it can't be preceded any more, the whole mean of it and up to `length` before it.

    data holds a byte a pixel. A frame up to `late` behind the latest is taken in its place,
    one still later is left out. The state is what waits and a clip's last `length` frames.
    """
    schema = "media_id string, frame_idx long, data binary"
    return frames.withWatermark("ts", late).groupBy("media_id").transformWithStateInPandas(FrameHistory(length, keep), schema, "append", "EventTime")
