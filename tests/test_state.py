"""Frame history in a stream with late and repeated frames and a restart, against the same in order."""

import datetime

import numpy as np
import pytest

from framelytics.streaming import state

FRAMES = "media_id string, frame_idx long, ts timestamp, data binary"
START = datetime.datetime(2024, 1, 1)


def row(media_id, k, values, seconds=None):
    return media_id, k, START + datetime.timedelta(seconds=10 * k if seconds is None else seconds), bytes(values)


def means(values, length):
    return [bytes((np.stack(values[max(0, k - length) : k + 1]).astype(int).sum(axis=0) // min(k + 1, length + 1)).astype(np.uint8)) for k in range(len(values))]


@pytest.fixture
def store(spark):
    before = spark.conf.get(state.STORE[0])
    spark.conf.set(*state.STORE)
    yield
    spark.conf.set(state.STORE[0], before)


def test_late_repeated_and_restarted(spark, store, tmp_path):
    rng = np.random.default_rng(0)
    values = {m: rng.integers(0, 256, (12, 5), dtype=np.uint8) for m in ("a", "b")}
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def add(rows):
        spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(source)
        q = state.frame_history(stream, 3, "35 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    def rows(m, ks):
        return [row(m, k, values[m][k]) for k in ks]

    add(rows("a", [1, 0, 2]) + rows("b", [0]))
    add(rows("a", [4, 3, 3]) + rows("b", [2, 1]))  # out of order, and one twice
    run()
    add(rows("a", [5, 7, 4]) + rows("b", [5, 3, 4]))
    add(rows("a", [6, 9, 8, 6]) + rows("b", [7, 6]))  # 6 comes after 7
    run()  # goes on where the first left off
    add(rows("a", [11, 10]) + rows("b", [8, 9, 10, 11]))
    add([row("c", 0, [0] * 5, 1000)])
    run()
    add([row("a", 99, [9] * 5, 50), row("c", 1, [0] * 5, 1100)])  # far too late: left out
    run()
    found = spark.read.parquet(out).where("media_id IN ('a', 'b')").collect()
    for m in values:
        own = sorted((r["frame_idx"], bytes(r["data"])) for r in found if r["media_id"] == m)
        assert own == list(enumerate(means(list(values[m]), 3)))
