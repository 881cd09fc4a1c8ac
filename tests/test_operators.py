"""Known values, invariants, sinks, sources and streams."""

import wave

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelytics.functions import scalars as X
from framelytics.operators import frames as P
from framelytics.operators import series as S
from framelytics.operators import spectra as T
from framelytics.operators.spectra import in_blocks
from framelytics.sources import adapters as A
from framelytics.sources import media
from framelytics.streaming import streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    assert value(spark, X.roundup(F.lit(10), 4)) == 12
    assert value(spark, X.roundup(F.lit(-71), 3)) == -69
    assert value(spark, X.scale_num(F.lit(13.1), 12.2, 15.3, -42.42, 42.42)) == pytest.approx(-17.789032258064516)
    assert value(spark, X.frame2ms(F.lit(1234), 56)) == 22036
    assert value(spark, X.frame2ms(F.lit(1234.56), 78.9)) == 15647
    assert value(spark, X.str2sec(F.lit("01:02:03"))) == 3723
    assert value(spark, X.clamp(F.lit(7.0), 0.0, 5.0)) == 5.0
    assert value(spark, X.wrap_str(F.lit("a b"))) == '"a b"'
    assert value(spark, X.unwrap_str(F.lit('"a b"'))) == "a b"
    assert value(spark, X.duration_string(F.lit(3723.25))) == "01:02:03.250"
    assert value(spark, X.box_ratio(F.lit(10.0), F.lit(10.0), F.lit(5.0), F.lit(5.0))) == 1.0


def still(spark, levels):
    return spark.createDataFrame([(0, t, y, x, v) for t, v in enumerate(levels) for y in range(4) for x in range(4)], "media_id int, frame_idx int, y int, x int, v int")


def test_no_motion(spark):
    m = P.motion(P.threshold(P.difference(still(spark, [9, 9, 9])), 0.05), 4, 4, 25.0).collect()
    assert len(m) == 2 and all(r["Qom"] == 0 and r["ComX"] == 0 and r["ComY"] == 1 for r in m)


def test_trim_joins_back(spark, data):
    px = A.pixels(spark, data).where("media_id = 0")
    n = px.agg(F.max("frame_idx")).first()[0] + 1
    back = media.concatenate([P.trim(px, 0, 0.4, 25.0), P.trim(px, 0.4, 0, 25.0)])
    assert back.exceptAll(px).count() == 0 and back.count() == n * 64


def test_median_is_numpys(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (5, 6))
    px = spark.createDataFrame([(0, 0, y, x, int(a[y, x])) for y in range(5) for x in range(6)], "media_id int, frame_idx int, y int, x int, v int")
    padded = np.pad(a, 1)
    for r in P.median(px, 3).collect():
        assert r["v"] == np.median(padded[r["y"] : r["y"] + 3, r["x"] : r["x"] + 3])


def test_similarity_is_symmetric_and_blocks_do_not_matter(spark, data):
    f = S.normalised(A.clips(spark, data).where("media_id < 2"), "l2")
    one, two = (S.self_similarity(f, b).select("media_id", "i", "j", F.round("s", 9).alias("s")) for b in (512, 7))
    assert one.exceptAll(two).count() == 0
    assert one.where("i = j AND abs(s - 1) > 1e-6").count() == 0


def test_suppression(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 1, 1.0, 1.0, 9.0, 9.0, 0.8), (1, 2, 50.0, 50.0, 60.0, 60.0, 0.1), (2, 0, 0.0, 0.0, 9.0, 9.0, 0.1)], "frame_idx int, box int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted((r["frame_idx"], r["box"]) for r in S.suppressed(b).collect()) == [(1, 0), (1, 2), (2, 0)]


def test_wave_and_sinks(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    assert [r["y"] for r in media.read_wave(spark, str(tmp_path / "a.wav")).orderBy("n").collect()] == [0, 0.5, -1]
    media.write_series(spark.createDataFrame([(1, 0.25)], "Time long, Qom double"), str(tmp_path / "out"), "tsv")
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).first()["Qom"] == "0.250000000000000"
    with pytest.raises(ValueError):
        media.write_series(spark.range(1), str(tmp_path / "x"), "xls")


def test_stream_equals_batch(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    e = spark.read.parquet(f"{data}/events.parquet")
    e.write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = streams.tumbling(streams.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["w"]["start"], r["event_type"], r["n"]) for r in spark.sql("SELECT * FROM days").collect()}
    want = {(r["w"]["start"], r["event_type"], r["n"]) for r in streams.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got == want


def test_motion_area_is_the_largest_flood_filled_area(spark):
    random = np.random.default_rng(3)
    clips = random.integers(0, 256, (12, 6, 7)) * (random.random((12, 6, 7)) < 0.6)
    px = spark.createDataFrame([(1, f, y, x, int(clips[f, y, x])) for f in range(12) for y in range(6) for x in range(7)], "media_id int, frame_idx int, y int, x int, v int")
    got = {r["frame_idx"]: tuple(r)[2:] for r in P.motion_area(px, 3, 2, 7, 6).collect()}
    for f in range(12):
        near = lambda y, x: clips[f, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean()
        left = {(y, x) for y in range(6) for x in range(7) if not clips[f, y, x] > near(y, x) - 2}
        best = []
        for start in sorted(left):
            area, todo = [], [start] if start in left else []
            left -= {start}
            while todo:
                y, x = todo.pop()
                area.append((y, x))
                found = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= found
                todo += found
            best = max(best, area, key=len)
        ys, xs = zip(*best)
        assert got[f] == pytest.approx((min(xs) / 7, min(ys) / 6, (max(xs) + 1) / 7, (max(ys) + 1) / 6))


def test_blocks_give_what_one_window_gives(spark):
    s = spark.range(50).selectExpr("cast(id % 2 as int) AS media_id", "cast(id div 2 as int) AS n", "cast(id * id as double) AS y")
    blocks, order, own = in_blocks(s, ["media_id"], "n", 3, 2, block=4)
    got = blocks.withColumn("z", F.sum("y").over(order.rowsBetween(-3, 2))).where(own).drop("_b")
    want = s.withColumn("z", F.sum("y").over(Window.partitionBy("media_id").orderBy("n").rowsBetween(-3, 2)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_harmonic_and_percussive_parts(spark):
    """A steady tone is harmonic, a click in one frame percussive."""
    spec = spark.createDataFrame([(1, f, k, 10.0 if k == 4 or f == 8 else 0.0) for f in range(17) for k in range(9)], "media_id int, frame_idx int, k int, mag double")
    found = {(r["frame_idx"], r["k"]): r for r in T.harmonic_percussive(spec, 5, (1.0, 1.0)).collect()}
    assert found[2, 4]["harmonic"] == 10 and found[2, 4]["percussive"] == 0
    assert found[8, 1]["percussive"] == 10 and found[8, 1]["harmonic"] == 0
    assert found[8, 4]["harmonic"] == found[8, 4]["percussive"] == 5
