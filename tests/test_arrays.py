"""Contours, masks of boxes, adaptive denoising and a detector's maps against loops and hand-made images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelytics.operators import arrays as R
from framelytics.operators import detect
from framelytics.operators import series as S
from tests.test_flow import rows_of


def found(df):
    return {(r["media_id"], r["frame_idx"]): np.array(r["data"]).reshape(r["height"], r["width"]) for r in df.collect()}


def parts(on):
    """Areas by flood fill in eight directions, as masks, topmost first."""
    left, out = on.copy(), []
    while left.any():
        todo, mask = [tuple(np.argwhere(left)[0])], np.zeros_like(on)
        while todo:
            y, x = todo.pop()
            if 0 <= y < on.shape[0] and 0 <= x < on.shape[1] and left[y, x]:
                left[y, x], mask[y, x] = False, True
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        out.append(mask)
    return out


def filled_area(mask):
    """Squares between four pixels count 1, between three a half, once the holes are filled."""
    wide = np.pad(~mask, 1, constant_values=True)
    outside, todo = np.zeros_like(wide), [(0, 0)]
    while todo:
        y, x = todo.pop()
        if 0 <= y < wide.shape[0] and 0 <= x < wide.shape[1] and wide[y, x] and not outside[y, x]:
            outside[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    solid = ~outside
    n = solid[:-1, :-1].astype(int) + solid[1:, :-1] + solid[:-1, 1:] + solid[1:, 1:]
    return (n == 4).sum() + (n == 3).sum() / 2


def test_contours_by_flood_fill(spark):
    rng = np.random.default_rng(0)
    images = [(rng.random((12, 15)) < p).astype(float) for p in np.linspace(0.1, 0.9, 40)]
    rows = R.contour_box(rows_of(spark, images)).orderBy("frame_idx").collect()
    for on, row in zip((a > 0 for a in images), rows, strict=True):
        masks = parts(on)
        areas = [filled_area(m) for m in masks]
        ys, xs = np.nonzero(masks[int(np.argmax(areas))])
        assert row["area"] == max(areas)
        assert [row[c] for c in ("AomX1", "AomY1", "AomX2", "AomY2")] == pytest.approx([xs.min() / 15, ys.min() / 12, (xs.max() + 1) / 15, (ys.max() + 1) / 12])


def test_ring_against_blob(spark):
    a = np.zeros((30, 40))
    a[2:22, 2:22] = 1
    a[3:21, 3:21] = 0  # a ring of 76 pixels around 361 squares
    a[5:15, 25:38] = 1  # a blob of 130 pixels, 108 squares
    line = np.zeros((30, 40))
    line[7, 3:30] = 1
    row, thin, none = R.contour_box(rows_of(spark, [a, line, line * 0])).orderBy("frame_idx").collect()
    assert row["area"] == 361.0 and row["AomX2"] == 22 / 40  # most pixels would give the blob
    assert thin["area"] == 0.0 and thin["AomX1"] == 3 / 40 and (none["AomX2"], none["area"]) == (0.0, 0.0)


def boxes(spark, rows):
    return spark.createDataFrame([(0, t, k, *map(float, b)) for t, k, b in rows], "media_id int, frame_idx int, box int, x1 double, y1 double, x2 double, y2 double")


def test_blur_is_a_direct_mean(spark):
    a = np.random.default_rng(1).integers(0, 256, (24, 30)).astype(float)
    out = found(R.blur_boxes(rows_of(spark, [a, a]), boxes(spark, [(0, 0, (3, 4, 17, 13))])))
    want = a.copy()
    h, w, ky, kx = 9, 14, 4, 7
    at = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    for y in range(h):
        for x in range(w):
            near = [a[4 + at(y - ky // 2 + i, h), 3 + at(x - kx // 2 + j, w)] for i in range(ky) for j in range(kx)]
            want[4 + y, 3 + x] = np.rint(np.mean(near))
    assert (out[0, 0] == want).all() and (out[0, 1] == a).all()
    round_ = found(R.blur_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (3, 4, 17, 13))]), ellipse=True))[0, 0]
    inside = R.in_ellipse(9, 14)
    assert (round_[4:13, 3:17] == np.where(inside, want[4:13, 3:17], a[4:13, 3:17])).all() and 0 < inside.sum() < inside.size


def test_boxes_one_after_another_and_scaled(spark):
    a = np.arange(400.0).reshape(20, 20) % 251
    one = found(R.blur_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (2, 2, 10, 10)), (0, 1, (5, 5, 15, 15))])))[0, 0]
    two = found(R.blur_boxes(rows_of(spark, [found(R.blur_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (2, 2, 10, 10))])))[0, 0]]), boxes(spark, [(0, 0, (5, 5, 15, 15))])))[0, 0]
    assert (one == two).all()
    wide = found(R.blur_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (8, 8, 12, 12))]), scale=2.0))[0, 0]
    changed = np.argwhere(wide != a)
    assert changed.min() >= 6 and changed.max() <= 13 and len(changed) > 16
    assert (found(R.blur_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (9, 9, 9, 12)), (0, 1, (-9, -9, -2, -2))])))[0, 0] == a).all()  # nothing inside


def test_pictures_cover_boxes(spark):
    a, picture = np.full((12, 12), 100.0), np.array([[0.0, 200.0]])
    plain = found(R.cover_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (2, 2, 6, 6))]), picture))[0, 0]
    assert plain[3, 2] == 0 and plain[3, 5] == 200 and (plain[:, 6:] == 100).all()
    half = found(R.cover_boxes(rows_of(spark, [a]), boxes(spark, [(0, 0, (2, 2, 6, 6))]), picture, np.full((1, 2), 51.0)))[0, 0]
    assert half[3, 2] == 80 and half[3, 5] == 120


@pytest.mark.parametrize("together", [True, False])
def test_denoising_by_loop(spark, together):
    rng = np.random.default_rng(3)
    steps = np.cumsum(rng.integers(-2, 3, (150, 2, 3)), axis=0)
    a = np.clip(100 + steps + 60 * (np.arange(150) // 50 % 2)[:, None, None], 0, 255)
    radius, single, total = 64, 5, 40
    out = found(R.adaptive_denoise(rows_of(spark, list(a.astype(float))), radius, single / 255 + 1e-9, total / 255 + 1e-9, together, block=40))
    for t in range(150):
        for y in range(2):
            for x in range(3):
                v, taken, gone, going = int(a[t, y, x]), [int(a[t, y, x])], [0, 0], [True, True]
                for k in range(1, radius + 1):
                    for side, s in enumerate((-k, k)):
                        if together and not all(going) or not going[side]:
                            continue
                        w = int(a[min(max(t + s, 0), 149), y, x])
                        gone[side] += abs(v - w)
                        if abs(v - w) > single or gone[side] > total:
                            going[side] = False
                        else:
                            taken.append(w)
                assert out[0, t][y, x] == (sum(taken) + len(taken) // 2) // len(taken)


def test_maps_to_boxes_that_stay(spark):
    cells = 6
    flat = lambda: [0.0] * (cells * cells)
    heat, marks = flat(), [flat() for _ in range(10)]
    for at, score in ((14, 0.9), (15, 0.6), (35, 0.5), (0, 0.05)):
        heat[at] = score
    marks[0][14], marks[1][14] = 0.25, 0.5
    scale = [float(np.log(2.0))] * (cells * cells)
    maps = spark.createDataFrame([(0, 0, heat, scale, scale, flat(), flat(), marks)], "media_id int, frame_idx int, heat array<double>, scale_y array<double>, scale_x array<double>, offset_y array<double>, offset_x array<double>, landmark array<array<double>>")
    boxes = detect.decode(maps, cells, 24, 22)
    rows = {r["box"]: r for r in boxes.collect()}
    assert set(rows) == {14, 15, 35}
    r = rows[14]  # row 2, column 2: centre at (10, 10), sides of 8
    assert [r[c] for c in ("x1", "y1", "x2", "y2")] == pytest.approx([6, 6, 14, 14]) and (r["lx1"], r["ly1"]) == pytest.approx((10, 8))
    assert rows[35]["x2"] == 22.0 and rows[35]["y2"] == 24.0
    assert sorted(x["box"] for x in S.suppressed(boxes, 0.3).collect()) == [14, 35]


def test_pixels_again(spark):
    a = np.arange(12.0).reshape(3, 4)
    px = R.pixel_rows(rows_of(spark, [a]))
    assert {(r["y"], r["x"]): r["v"] for r in px.collect()} == {(y, x): int(a[y, x]) for y in range(3) for x in range(4)}
    assert R.contour_box(rows_of(spark, [a]).where(F.lit(False))).count() == 0
