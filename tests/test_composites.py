"""Colour, feature and fact operators against plain loops and known values; streams with late frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelytics.functions import scalars as X
from framelytics.operators import colour as C
from framelytics.operators import features as V
from framelytics.operators import frames as P
from framelytics.operators import series as S
from framelytics.sources import adapters as A
from framelytics.sources import probe
from framelytics.streaming import streams


def pixels(spark, a):
    rows = [(0, t, y, x, int(a[t, y, x])) for t in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "media_id int, frame_idx int, y int, x int, v int")


def image(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["frame_idx"], r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).integers(0, 256, (6, 5, 7))


def test_neighbourhoods_by_hand(spark, noise):
    px, (t, h, w) = pixels(spark, noise), noise.shape
    padded = np.pad(noise, ((0, 0), (2, 2), (2, 2)))
    ones = np.pad(np.ones_like(noise), ((0, 0), (2, 2), (2, 2)))
    cut = lambda a, k, y, x: a[:, y + 2 - k // 2 : y + 2 - k // 2 + k, x + 2 - k // 2 : x + 2 - k // 2 + k]
    for k in (3, 4):
        want = np.stack([[cut(padded, k, y, x).sum(axis=(1, 2)) // cut(ones, k, y, x).sum(axis=(1, 2)) for x in range(w)] for y in range(h)]).transpose(2, 0, 1)
        assert (image(P.box_blur(px, k), noise.shape) == want).all()
    want = np.stack([[np.median(cut(padded, 5, y, x), axis=(1, 2)) for x in range(w)] for y in range(h)]).transpose(2, 0, 1)
    assert (image(P.median(px, 5), noise.shape) == want).all()


def test_history_by_loop(spark, noise):
    found = image(P.exact_history(pixels(spark, noise), 2, [2.0, 3.0]), noise.shape)
    mass, tail = 2 + 1 + (2 - 1) + (3 - 1), []
    for t in range(len(noise)):
        want = noise[t] if not tail else noise[t] * 2.0 / mass + sum(f * w / mass for f, w in zip(tail, (3.0, 1.0)))
        assert (found[t] == np.floor(np.round(want, 9))).all()
        tail = (tail + [noise[t]])[-2:]


def test_levels_of_one_pixel(spark):
    a = np.array([100, 0, 200, 40]).reshape(4, 1, 1)
    assert image(P.exact_history(pixels(spark, a), 2, [2.0, 1.0, 3.0]), a.shape).ravel()[[0]].tolist() == [100]


def test_black_image_has_its_centroid_at_the_bottom(spark):
    m = P.motion(pixels(spark, np.zeros((1, 4, 4), int)), 1, 1, 25.0).first()
    assert (m["ComX"], m["ComY"]) == (0, 1)


def test_arrays_and_frame_tables(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (3, 4, 5, 3)).astype(np.uint8)
    px = V.frames_from_arrays(spark, {7: a})
    V.frame_table(px, 5, 4).write.parquet(f"{tmp_path}/frames")
    back = V.pixels_of(spark.read.parquet(f"{tmp_path}/frames"))
    assert back.exceptAll(px).count() == 0 and back.count() == a.size
    gray = image(C.grayscale(px), a.shape[:3])
    assert (gray == np.rint(0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2])).all()


def test_gaussian_threshold_by_hand(spark, noise):
    g, out = P.gaussian_weights(11), np.zeros_like(noise)
    t, h, w = noise.shape
    at = lambda n, i: np.clip(np.arange(i - 5, i + 6), 0, n - 1)
    for y in range(h):
        for x in range(w):
            mean = np.einsum("i,j,tij->t", g, g, noise[:, at(h, y)][:, :, at(w, x)])
            out[:, y, x] = np.where(noise[:, y, x] - np.rint(mean) > -2, 255, 0)
    assert (image(P.adaptive_gaussian(pixels(spark, noise)), noise.shape) == out).all() and sum(g) == pytest.approx(1)


def test_pyramid_by_loop(spark, noise):
    for mode, join in (("difference", lambda a, b: abs(a - b)), ("average", lambda a, b: (a + b) // 2), ("lighten", np.maximum), ("darken", np.minimum)):
        frames = list(noise)
        while len(frames) > 1:
            frames = [join(a, b) for a, b in zip(frames[::2], frames[1::2])]
        for r in P.blend_pyramid(pixels(spark, noise), mode).collect():
            assert r["v"] == frames[0][r["y"], r["x"]]


def test_tracks_follow_the_flow(spark):
    flow = spark.createDataFrame([(0, t, y, x, 1.0, 0.5) for t in range(4) for y in range(6) for x in range(6)], "media_id int, frame_idx int, y int, x int, fx double, fy double")
    points = spark.createDataFrame([(0, 1, 1), (0, 4, 3)], "media_id int, y int, x int")
    found = {(r["track"], r["frame_idx"]): (r["y"], r["x"]) for r in C.track(points, flow).collect()}
    assert found[0, 4] == (3.0, 5.0) and found[1, 3] == (5.5, 6.0) and (1, 4) not in found


def test_beats_of_clicks(spark):
    rows = [(0, n, 1.0 if n % 10 == 3 else 0.01 * (n % 3)) for n in range(200)]
    found = sorted(r["n"] for r in V.beats(spark.createDataFrame(rows, "media_id int, n int, y double"), 10.0, 60.0).collect())
    assert len([n for n in found if n % 10 == 3]) >= 18 and {3 + 10 * k for k in range(1, 18)} <= set(found)
    assert V.beats(spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0)], "media_id int, n int, y double"), 10.0, 60.0).count() == 0


def test_beats_are_brought_together(spark):
    audio, visual = [0.5, 1.0, 0.4, 2.0], [1.0, 0.1, 3.0, 1.0, 2.0, 1.0]
    steps = spark.createDataFrame([(0, "audio", k, x) for k, x in enumerate(audio)] + [(0, "visual", k, x) for k, x in enumerate(visual)], "media_id int, kind string, k long, step double")
    pairs, a, v, long = [], 0, 0, audio[0]
    while v < len(visual):  # the same rule, pair by pair
        change = visual[v] / long
        if change < 0.5:
            v += 1
        elif change > 2:
            a += 1
            long += audio[a % 4]
        else:
            pairs.append((long, visual[v]))
            a, v = a + 1, v + 1
            long = audio[a % 4]
    want = np.cumsum(np.array(pairs[:-1]), axis=0)
    met = V.synchronised(steps)
    found = [(r["audio"], r["visual"]) for r in met.orderBy("k").collect()]
    assert np.array(found) == pytest.approx(want)
    shown = {r["t"]: r["n"] for r in V.warp_frames(met, 10.0).collect()}
    assert shown[0] == 0 and max(shown) == math.floor(want[-1][0] * 10)


def test_probe_facts(spark):
    text = "Input #0, avi, from 'dance.avi':\n  Duration: 00:01:02.84, start: 0.000000, bitrate: 1500 kb/s\n    Stream #0:0: Video: mpeg4, yuv420p, 518x496 [SAR 1:1 DAR 259:248], 25 fps, 25 tbr\n    Stream #0:1: Audio: mp3, 44100 Hz\n"
    rows = [(1, text), (2, text.replace("Audio", "Data").replace("25 tbr", "25 tbr\n      displaymatrix: rotation of -90.00 degrees")), (3, "no streams"), (4, None)]
    found = {r["media_id"]: tuple(r)[1:] for r in probe.facts(spark.createDataFrame(rows, "media_id int, text string")).collect()}
    assert found[1] == (518, 496, 25.0, pytest.approx(62.84), True) and found[2][:2] == (496, 518) and found[2][4] is False
    assert found[3][:4] == (None, None, None, None) and found[4][:4] == (None, None, None, None)


def test_names_and_arguments():
    assert probe.free_name("a.avi", []) == "a.avi" and probe.free_name("a.avi", ["a.avi"]) == "a_0.avi"
    assert probe.free_name("a.avi", ["a.avi", "a_0.avi", "a_7.avi", "a_x.avi", "a_9.mp4"]) == "a_8.avi"
    probe.need_container("x/y.PNG", ".png")
    probe.need_same_container("a.mp4", "b.mp4")
    probe.need_arguments()
    for bad in ({"thresh": 2}, {"skip": -1}, {"filtertype": "x"}, {"frames": -2}, {"fps": 0}):
        with pytest.raises(ValueError):
            probe.need_arguments(**bad)
    with pytest.raises(probe.WrongContainer):
        probe.need_container("a.jpg", ".png")
    with pytest.raises(probe.WrongContainer):
        probe.need_same_container("a.jpg", "b.png")


def test_frame_groups_overlap_by_one():
    assert X.frame_groups(10, 3) == [(0, 5), (4, 5), (8, 2)] and X.frame_groups(3, 1) == [(0, 3)]


def test_numbers_by_buckets(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 500).alias("at"))
    found = A.numbered(rows, "k", ["at"], F.floor(F.col("at") / 16), "n").collect()
    for k in range(3):
        own = sorted((r["at"], r["n"]) for r in found if r["k"] == k)
        assert [n for _, n in own] == list(range(len(own)))


def test_impact_envelope_by_hand(spark):
    rng = np.random.default_rng(2)
    d = np.where(rng.random((12, 20)) < 0.6, rng.random((12, 20)), 0)
    d[3] = 0
    rows = [(0, t, b, float(d[t, b])) for t in range(12) for b in range(20) if d[t, b]]
    padded = np.pad(d, 2)
    smooth = np.array([[np.median(padded[t : t + 5, b : b + 5]) for b in range(20)] for t in range(12)])
    rise = np.r_[0, np.maximum(np.diff(smooth, axis=0), 0).sum(axis=1)]
    rise[rise > np.percentile(rise, 98)] = 0
    found = S.impact_envelope(spark.createDataFrame(rows, "media_id int, frame_idx int, bin int, mag double"), 20).orderBy("n").collect()
    assert [r["y"] for r in found] == pytest.approx(list(rise / rise.max()))


def test_late_frames_are_compared_in_their_place(spark, tmp_path):
    import datetime

    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(seconds=10 * k)
    frame = lambda k: ("m", k, at(k), bytearray([min(k * k, 255)] * 4))
    schema = "media_id string, frame_idx long, ts timestamp, data binary"
    for k, part in enumerate(([0, 1, 3], [2, 4], [60], [61])):  # 2 comes late; 60 moves the watermark on
        spark.createDataFrame([frame(i) for i in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = streams.frame_difference(stream, "1 minute").writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["frame_idx"]: r["change"] for r in spark.table("changes").collect()}
    assert {k: found[k] for k in (1, 2, 3, 4)} == {1: 1.0, 2: 3.0, 3: 5.0, 4: 7.0}


def test_sessions_of_a_stream_end(spark, data, tmp_path):
    from framelytics.sources.adapters import table

    events = table(spark, data, "events")
    events.write.parquet(f"{tmp_path}/in")
    query = streams.sessions(streams.event_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("ended").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    every = streams.sessions(events).count()
    assert 0 < spark.table("ended").count() <= every
