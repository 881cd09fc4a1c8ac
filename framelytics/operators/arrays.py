"""Operators on frames as rows (media_id, frame_idx, height, width, data): contours, masks of boxes, adaptive denoising.

Batches of frames go through a task together; nothing is called a frame or a pixel at a time
by Spark. Frames come from `flow.frame_rows` and go back to pixels by `pixel_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow import scaled
from .signal import _arrow, _kinds, _repeated

FRAME = ["media_id", "frame_idx"]


def pixel_rows(frames: DataFrame) -> DataFrame:
    """(media_id, frame_idx, y, x, v): a row a pixel, whole levels."""
    cells = frames.select(*FRAME, "width", F.posexplode("data").alias("i", "v"))
    return cells.select(*FRAME, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), F.col("v").cast("int").alias("v"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(np.float64)))


def each_image(frames: DataFrame, run: Callable[..., np.ndarray], *others: str) -> DataFrame:
    """frames with data replaced by run(image, the frame's values of `others`)."""

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [batch.column(k + 5).to_pylist() for k in range(len(others))]
            shapes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            done = [np.asarray(run(data.values.to_numpy().reshape(shape), *(m[k] for m in more))).ravel() for k, (shape, data) in enumerate(zip(shapes, batch.column(4), strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(done)], names=batch.schema.names[:5])

    return frames.select(*FRAME, "height", "width", "data", *others).mapInArrow(by_batch, f"{_kinds(frames, [*FRAME, 'height', 'width'])}, data array<double>")


# Contours


def components(on: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The areas of set pixels that join in eight directions, each as its runs (row, first, last), by their topmost, then leftmost pixel."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    above: list[int] = []
    for y, row in enumerate(on):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b - 1))
            parent.append(k)
            while at < len(above) and runs[above[at]][2] < a - 1:
                at += 1
            for j in above[at:]:
                if runs[j][1] > b:
                    break
                x, z = sorted((root(j), root(k)))
                parent[z] = x
            here.append(k)
        above = here
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, run in enumerate(runs):
        out.setdefault(root(k), []).append(run)
    return list(out.values())


#: The eight neighbours of a pixel, clockwise from the left.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def border(on: np.ndarray, y: int, x: int) -> list[tuple[int, int]]:
    """The pixels (y, x) along the outer border of the area whose topmost, then leftmost pixel is given.

    on has an empty margin. From each border pixel the search for the next goes clockwise,
    from the empty neighbour seen last, until the first step repeats.
    """
    out, at, seen, first = [], (y, x), 0, None
    while True:
        step = next((k % 8 for k in range(seen + 1, seen + 9) if on[at[0] + AROUND[k % 8][0], at[1] + AROUND[k % 8][1]]), None)
        if step is None:
            return [at]
        if (at, step) == first:
            return out
        first = first or (at, step)
        out.append(at)
        at = (at[0] + AROUND[step][0], at[1] + AROUND[step][1])
        seen = step + 5 if step % 2 else step + 6  # the empty neighbour before `step`, seen from the new pixel
        seen %= 8


def shoelace(points: list[tuple[int, int]]) -> float:
    """The area of the polygon through these points."""
    y, x = np.array(points, np.int64).T
    return abs(int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def largest_contour(on: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """(x1, y1, x2, y2, area) of the outer contour with the greatest area through its pixels' centres; of equals the topmost, then leftmost.

    What lies within another area's hole can't be greatest. x2 and y2 are beyond the last pixel.
    """
    wide, best = np.pad(on, 1), None
    for runs in components(on):
        y, x, _ = runs[0]
        area = shoelace(border(wide, y + 1, x + 1))
        if best is None or area > best[4]:
            best = (min(r[1] for r in runs), y, max(r[2] for r in runs) + 1, max(r[0] for r in runs) + 1, area)
    return best


def contour_box(frames: DataFrame) -> DataFrame:
    """(media_id, frame_idx, AomX1, AomY1, AomX2, AomY2, area): the box of each frame's largest contour as shares of the frame.

    Pixels over 0 are set. Without any the box is 0; the area is in pixels.
    """
    names = ["AomX1", "AomY1", "AomX2", "AomY2", "area"]

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for height, width, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                found = largest_contour(data.values.to_numpy().reshape(height, width) > 0)
                rows.append([0.0] * 5 if found is None else [found[0] / width, found[1] / height, found[2] / width, found[3] / height, found[4]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5))], names=[*FRAME, *names])

    return frames.select(*FRAME, "height", "width", "data").mapInArrow(by_batch, f"{_kinds(frames, FRAME)}, {', '.join(f'{n} double' for n in names)}")


# Masks of boxes


def box_mean(image: np.ndarray, ky: int, kx: int) -> np.ndarray:
    """Rounded means over ky x kx around each pixel by a summed-area table: four look-ups a pixel, whatever the window.

    The image is mirrored about its outermost pixels; an even window reaches one further back.
    """
    ky, kx = max(1, ky), max(1, kx)
    wide = image
    for axis, k in ((0, ky), (1, kx)):
        if image.shape[axis] == 1:
            wide = np.concatenate([wide] * k, axis=axis) if k > 1 else wide
        else:
            wide = np.pad(wide, [(k // 2, k - 1 - k // 2) if a == axis else (0, 0) for a in range(2)], mode="reflect")
    sums = np.zeros((wide.shape[0] + 1, wide.shape[1] + 1))
    sums[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    return np.rint((sums[ky:, kx:] - sums[:-ky, kx:] - sums[ky:, :-kx] + sums[:-ky, :-kx]) / (ky * kx))


def in_ellipse(height: int, width: int) -> np.ndarray:
    """Which pixels of a box are within the ellipse about (height // 2, width // 2) with these as radii."""
    cy, cx = height // 2, width // 2
    if not cy or not cx:
        return np.zeros((height, width), bool)
    y, x = np.mgrid[:height, :width]
    return ((y - cy) / cy) ** 2 + ((x - cx) / cx) ** 2 < 1


def grown(box: dict, scale: float, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    """The whole-numbered box about the same centre, scale times its size, within the image but for its last row and column."""
    x1, y1, x2, y2 = (int(box[c]) for c in ("x1", "y1", "x2", "y2"))
    more = scale - 1.0
    h, w = y2 - y1, x2 - x1
    x1, y1, x2, y2 = int(x1 - w * more / 2), int(y1 - h * more / 2), int(x2 + w * more / 2), int(y2 + h * more / 2)
    return max(0, x1), max(0, y1), min(shape[1] - 1, x2), min(shape[0] - 1, y2)


def with_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """frames with an array of their boxes (box, x1, y1, x2, y2) in the order of box; null where there are none."""
    own = boxes.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("box", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))).alias("boxes"))
    return frames.join(own, FRAME, "left")


def blur_boxes(frames: DataFrame, boxes: DataFrame, factor: int = 2, ellipse: bool = False, scale: float = 1.0) -> DataFrame:
    """frames in which each box, one after another, is blurred over its size // factor, or only the ellipse within it."""

    def run(image: np.ndarray, boxes: list[dict] | None) -> np.ndarray:
        image = image.copy()
        for box in boxes or []:
            x1, y1, x2, y2 = grown(box, scale, image.shape)
            if x2 > x1 and y2 > y1:
                part = image[y1:y2, x1:x2]
                blurred = box_mean(part, (y2 - y1) // factor, (x2 - x1) // factor)
                image[y1:y2, x1:x2] = np.where(in_ellipse(*part.shape), blurred, part) if ellipse else blurred
        return image

    return each_image(with_boxes(frames, boxes), run, "boxes")


def cover_boxes(frames: DataFrame, boxes: DataFrame, picture: np.ndarray, alpha: np.ndarray | None = None, scale: float = 1.0) -> DataFrame:
    """frames in which a picture, resized to each box, covers it; with alpha (0 to 255, the picture's size) it lets the frame through."""

    def run(image: np.ndarray, boxes: list[dict] | None) -> np.ndarray:
        image = image.copy()
        for box in boxes or []:
            x1, y1, x2, y2 = grown(box, scale, image.shape)
            if x2 > x1 and y2 > y1:
                a, cover = (None if v is None else np.rint(scaled(v.astype(float), y2 - y1, x2 - x1)) for v in (alpha, picture))
                image[y1:y2, x1:x2] = cover if a is None else np.floor(image[y1:y2, x1:x2] * (1 - a / 255) + cover * (a / 255))
        return image

    return each_image(with_boxes(frames, boxes), run, "boxes")


# Denoising over time


def adaptive_mean(frames: np.ndarray, first: int, last: int, radius: int, single: int, total: int, together: bool) -> np.ndarray:
    """Of frames first to last (exclusive) of (time, ...): means over a window that grows from each pixel both ways.

    A side takes the next frame unless that differs from the centre by more than `single`, or
    all it has looked at by more than `total`. With `together` the first such frame, the
    earlier one before the later one, stops both sides. Means are rounded half up. frames have
    `radius` frames before first and after last.
    """
    centre = frames[first:last].astype(np.int64)
    sums, taken = centre.copy(), np.ones_like(centre)
    going = [np.ones(centre.shape, bool), np.ones(centre.shape, bool)]
    gone = [np.zeros_like(centre), np.zeros_like(centre)]
    for k in range(1, radius + 1):
        if not (going[0].any() or going[1].any()):
            break
        for side, shift in enumerate((-k, k)):
            other = frames[first + shift : last + shift].astype(np.int64)
            away = np.abs(centre - other)
            gone[side] += away
            going[side] &= (away <= single) & (gone[side] <= total)
            if together:
                going[1 - side] &= going[side]
            sums += np.where(going[side], other, 0)
            taken += going[side]
    return (sums + taken // 2) // taken


def adaptive_denoise(frames: DataFrame, radius: int = 64, single: float = 0.02, total: float = 0.04, together: bool = True, block: int = 256) -> DataFrame:
    """frames of whole levels, each pixel averaged over the frames around it that stay close to it; see `adaptive_mean`.

    single and total are shares of 255. The first and the last frame of a clip go on beyond
    its ends. A task holds a block of frames and `radius` more on both sides; a clip's frames
    have one size and follow each other.
    """
    at = F.col("frame_idx")
    near = frames.withColumn("b", F.explode(F.sequence(F.greatest(F.floor((at - radius) / block), F.lit(0)), F.floor((at + radius) / block))))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        t, begin = rows.column("frame_idx").to_numpy(), key[1].as_py() * block
        own = np.flatnonzero((t >= begin) & (t < begin + block))
        if not len(own):
            return rows.select([*FRAME, "height", "width", "data"]).slice(0, 0)
        data = rows.column("data").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        before, after = int(own[0]), len(t) - 1 - int(own[-1])
        wide = np.pad(data, ((radius - before, radius - after), (0, 0)), mode="edge")
        out = adaptive_mean(wide, radius, radius + len(own), radius, int(single * 255), int(total * 255), together)
        own_rows = rows.slice(before, len(own))
        return pa.Table.from_arrays([*_repeated(key[:1], types, len(own)), *(own_rows.column(c).combine_chunks() for c in ("frame_idx", "height", "width")), _lists(list(out))], names=[*FRAME, "height", "width", "data"])

    types = [_arrow(frames, "media_id")]
    return near.groupBy("media_id", "b").applyInArrow(run, f"{_kinds(frames, [*FRAME, 'height', 'width'])}, data array<double>")
