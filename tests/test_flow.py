"""Dense flow and followed points on images whose motion is known, and the quadratic fit by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelytics.operators import flow as O
from framelytics.operators import frames as P

SIDE = 48


@pytest.fixture(scope="module")
def texture():
    a = O.smooth(np.random.default_rng(0).standard_normal((110, 110)), 2.5)
    return (a - a.min()) / (a.max() - a.min()) * 255


def view(texture, dy, dx, zoom=1.0):
    """A cut of the texture whose content has moved by (dy, dx) and grown about the middle."""
    y, x = np.meshgrid(np.arange(float(SIDE)), np.arange(float(SIDE)), indexing="ij")
    c = (SIDE - 1) / 2
    return O.sampled(texture, 30 + c + (y - c) / zoom - dy, 30 + c + (x - c) / zoom - dx)


def rows_of(spark, images, media_id=0):
    rows = [(media_id, t, *a.shape, a.ravel().tolist()) for t, a in enumerate(images)]
    return spark.createDataFrame(rows, "media_id int, frame_idx int, height int, width int, data array<double>")


def grids(flow):
    return {(r["media_id"], r["frame_idx"]): np.stack([np.array(r[c]).reshape(r["height"], r["width"]) for c in ("fx", "fy")], axis=-1) for r in flow.collect()}


def test_fit_by_brute_force():
    image = np.random.default_rng(1).random((14, 15))
    found = O.expansion(image, 2, 1.2)
    d = np.arange(-2, 3)
    y, x = (v.ravel() for v in np.meshgrid(d, d, indexing="ij"))
    root = np.exp(-0.25 * (x**2 + y**2) / 1.2**2)
    basis = np.stack([x**0, x, y, x * x, y * y, x * y], axis=1)
    for at in ((2, 2), (7, 9), (11, 12)):
        patch = image[at[0] - 2 : at[0] + 3, at[1] - 2 : at[1] + 3].ravel()
        assert np.allclose(found[at], np.linalg.lstsq(basis * root[:, None], patch * root, rcond=None)[0][1:])


def test_shift_is_found_where_one_level_fails(spark, texture):
    images = [view(texture, t, 2 * t) for t in range(6)]
    found = grids(O.dense_flow(rows_of(spark, images), block=2))
    assert sorted(found) == [(0, t) for t in range(5)]
    inside = (slice(14, -14), slice(14, -14))
    for f in found.values():
        assert abs(f[inside] - [2, 1]).max() < 0.1
    px = spark.createDataFrame([(0, t, y, x, int(round(images[t][y, x]))) for t in range(2) for y in range(SIDE) for x in range(SIDE)], "media_id int, frame_idx int, y int, x int, v int")
    plain = P.window_flow(px, 3).where(F.col("y").between(14, SIDE - 15) & F.col("x").between(14, SIDE - 15)).toPandas()
    assert (abs(plain["fx"] - 2) > 0.1).mean() > 0.5


def test_zoom(spark, texture):
    f = grids(O.dense_flow(rows_of(spark, [view(texture, 0, 0), view(texture, 0, 0, 1.04)]), window=9))[0, 0]
    y, x = np.meshgrid(np.arange(float(SIDE)), np.arange(float(SIDE)), indexing="ij")
    c = (SIDE - 1) / 2
    away = abs(f - np.stack([(x - c) * 0.04, (y - c) * 0.04], axis=-1))[10:-10, 10:-10]
    assert away.mean() < 0.05 and np.quantile(away, 0.95) < 0.1  # one shift for all of a window, so small windows fit a zoom


def test_pixels_and_other_sizes(spark):
    frames = rows_of(spark, [np.zeros((6, 5)), np.zeros((6, 5)), np.zeros((4, 5))])
    cells = O.flow_pixels(O.dense_flow(frames, n=1, window=3))
    assert cells.count() == 30 and cells.where("fx != 0 OR fy != 0 OR frame_idx != 0").count() == 0  # none from or to a frame of another size
    again = O.frame_rows(spark.createDataFrame([(0, 0, y, x, 10 * y + x) for y in range(3) for x in range(4)], "media_id int, frame_idx int, y int, x int, v int")).first()
    assert (again["height"], again["width"]) == (3, 4) and again["data"] == [float(10 * y + x) for y in range(3) for x in range(4)]


def square(dy, dx):
    a = np.zeros((60, 70))
    a[20 + dy : 36 + dy, 14 + dx : 30 + dx] = 200
    return a


def test_square_is_followed_until_it_is_lost(spark):
    images = [square(t, 3 * t) for t in range(10)]
    frames = rows_of(spark, images).unionByName(rows_of(spark, images[:4], 1))
    points = spark.createDataFrame([(m, k, y, x) for m in (0, 1) for k, (y, x) in enumerate([(20.0, 14.0), (35.0, 29.0), (50.0, 5.0)])], "media_id int, track int, y double, x double")
    found = O.tracks(frames, points, block=3).toPandas()
    assert not found.duplicated(["media_id", "track", "frame_idx"]).any()
    for m, last in ((0, 9), (1, 3)):
        for k, (y, x) in enumerate([(20, 14), (35, 29)]):
            own = found[(found["media_id"] == m) & (found["track"] == k)].sort_values("frame_idx")
            assert own["frame_idx"].tolist() == list(range(last + 1))
            assert abs(own["y"] - (y + own["frame_idx"])).max() < 0.1 and abs(own["x"] - (x + 3 * own["frame_idx"])).max() < 0.1
        assert found[(found["media_id"] == m) & (found["track"] == 2)]["frame_idx"].tolist() == [0]  # a flat place has nothing to follow


def test_leaving_the_image_ends_a_track(spark, texture):
    images = [view(texture, 0, 4 * t) for t in range(7)]
    points = spark.createDataFrame([(0, 0, 20.0, 33.0)], "media_id int, track int, y double, x double")
    found = O.tracks(rows_of(spark, images), points).orderBy("frame_idx").toPandas()
    inside = found[found["frame_idx"] <= 2]
    assert len(inside) == 3 and abs(inside["x"] - (33 + 4 * inside["frame_idx"])).max() < 0.1
    assert found["frame_idx"].max() < 5 and found["x"].max() <= SIDE - 1  # at frame 4 it is beyond the border


def test_nothing(spark):
    frames, points = rows_of(spark, [np.zeros((4, 4))]).limit(0), spark.createDataFrame([], "media_id int, track int, y double, x double")
    assert O.dense_flow(frames).count() == 0 and O.tracks(frames, points).count() == 0
