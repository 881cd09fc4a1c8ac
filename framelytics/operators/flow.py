"""Optical flow between frames: dense by polynomial expansion, and of points by image pyramids.

Dense flow follows G. Farnebäck, "Two-Frame Motion Estimation Based on Polynomial Expansion"
(2003), tracking J.-Y. Bouguet, "Pyramidal Implementation of the Lucas Kanade Feature Tracker"
(2000). A frame is one row with its pixels in an array; clips go by blocks of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import _arrays, _arrow, _kinds, _matrix, _repeated

FRAME = ["media_id", "frame_idx"]
#: Frames of a block.
BLOCK = 64


def frame_rows(px: DataFrame) -> DataFrame:
    """(media_id, frame_idx, height, width, data): a row a frame, its pixels by rows in an array of doubles. Frames are whole."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))))
    rows = px.groupBy(*FRAME).agg(cells.alias("cells"), (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    return rows.select(*FRAME, "height", "width", F.transform("cells", lambda c: c["v"]).alias("data"))


def in_blocks(frames: DataFrame, block: int, after: int = 1) -> DataFrame:
    """frames with a block b each, and once more for a block before whose last frames look so many ahead."""
    return frames.withColumn("b", F.explode(F.sequence(F.greatest(F.floor((F.col("frame_idx") - after) / block), F.lit(0)), F.floor(F.col("frame_idx") / block))))


def images(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The frames of a sorted table as matrices."""
    for t, height, width, data in zip(rows.column("frame_idx").to_pylist(), rows.column("height").to_pylist(), rows.column("width").to_pylist(), rows.column("data"), strict=True):
        yield t, data.values.to_numpy().reshape(height, width)


def along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """The correlation of a with a kernel of odd length along an axis; the edges go on."""
    r = len(kernel) // 2
    wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis) @ kernel


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return along(along(a, kernel, 0), kernel, 1)


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a (height, width, ...) at real places, bilinear; places outside are moved to the border."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    more = (...,) + (None,) * (a.ndim - 2)
    fy, fx = (y - y0)[more], (x - x0)[more]
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def scaled(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """a (height, width, ...) at another size, bilinear, places measured from pixel corners."""
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    return sampled(a, *np.meshgrid(y, x, indexing="ij"))


def expansion(image: np.ndarray, n: int, sigma: float) -> np.ndarray:
    """(height, width, 5): of the least-squares quadratic around each pixel the terms x, y, xx, yy, xy.

    Weights fall as a bell of sigma over 2n + 1 places each way, so sums go along one axis
    at a time; of the six terms only 1, xx and yy depend on each other.
    """
    x = np.arange(-n, n + 1)
    bell = np.exp(-0.5 * (x / sigma) ** 2)
    bell /= bell.sum()
    s2, s4 = (bell * x**2).sum(), (bell * x**4).sum()
    rows = [along(image, bell * x**k, 1) for k in range(3)]
    one, fx, fxx = (along(rows[k], bell, 0) for k in range(3))
    fy, fxy, fyy = along(rows[0], bell * x, 0), along(rows[1], bell * x, 0), along(rows[0], bell * x**2, 0)
    solve = np.linalg.inv(np.array([[1, s2, s2], [s2, s4, s2 * s2], [s2, s2 * s2, s4]]))
    fit = np.stack([one, fxx, fyy], axis=-1) @ solve.T
    return np.stack([fx / s2, fy / s2, fit[..., 1], fit[..., 2], fxy / (s2 * s2)], axis=-1)


def dense(a: np.ndarray, b: np.ndarray, scale: float = 0.5, levels: int = 3, window: int = 15, iterations: int = 3, n: int = 5, sigma: float = 1.2) -> np.ndarray:
    """(height, width, 2): how far in x and y each pixel of a has moved in b.

    At each level, the smallest image first, quadratics are fitted to both images and the
    shift that takes one to the other is solved for over `window` pixels, those of b being
    looked up where the shift so far leads; a pixel that leads outside doesn't count.
    Levels under 2n + 1 pixels are left out, but for the whole image.
    """
    sizes = [(a.shape[0], a.shape[1])]
    for k in range(1, levels + 1):
        size = (round(a.shape[0] * scale**k), round(a.shape[1] * scale**k))
        if min(size) < 2 * n + 1:
            break
        sizes.append(size)
    flow = np.zeros((*sizes[-1], 2))
    box = np.ones(window) / window
    for k in range(len(sizes) - 1, -1, -1):
        height, width = sizes[k]
        blur = max(0.0, (scale**-k - 1) / 2)
        small = [scaled(smooth(image, blur) if blur else image, height, width) for image in (a, b)]
        flow = scaled(flow, height, width) * (np.array([width, height]) / np.array([flow.shape[1], flow.shape[0]]))
        first, second = (expansion(image, n, sigma) for image in small)
        y, x = np.meshgrid(np.arange(height, dtype=float), np.arange(width, dtype=float), indexing="ij")
        for _ in range(iterations):
            ty, tx = y + flow[..., 1], x + flow[..., 0]
            inside = (ty >= 0) & (ty <= height - 1) & (tx >= 0) & (tx <= width - 1)
            other = sampled(second, ty, tx)
            mean = (first + other) / 2
            xx, yy, xy = mean[..., 2], mean[..., 3], mean[..., 4] / 2
            dx = (first[..., 0] - other[..., 0]) / 2 + xx * flow[..., 0] + xy * flow[..., 1]
            dy = (first[..., 1] - other[..., 1]) / 2 + xy * flow[..., 0] + yy * flow[..., 1]
            terms = np.stack([xx * xx + xy * xy, xy * (xx + yy), xy * xy + yy * yy, xx * dx + xy * dy, xy * dx + yy * dy], axis=-1) * inside[..., None]
            g11, g12, g22, h1, h2 = np.moveaxis(along(along(terms, box, 0), box, 1), -1, 0)
            g11, g22 = g11 + 1e-9, g22 + 1e-9
            det = g11 * g22 - g12 * g12
            flow = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det], axis=-1)
    return flow


def dense_flow(frames: DataFrame, scale: float = 0.5, levels: int = 3, window: int = 15, iterations: int = 3, n: int = 5, sigma: float = 1.2, block: int = BLOCK) -> DataFrame:
    """(media_id, frame_idx, height, width, fx, fy): arrays of the flow from each frame to the next; the last of a clip has none.

    frames as of `frame_rows`. A task holds a block of frames and the one after it. Frames of another
    size than the one before have no flow to them.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found, last = [], None
        for t, image in images(rows.sort_by("frame_idx")):
            if last is not None and last[0] == t - 1 and last[1].shape == image.shape:
                found.append((t - 1, *image.shape, dense(last[1], image, scale, levels, window, iterations, n, sigma)))
            last = (t, image)
        t, height, width = (pa.array([f[k] for f in found], pa.int32()) for k in range(3))
        x, y = (pa.array([f[3][..., k].ravel() for f in found], pa.list_(pa.float64())) for k in range(2))
        return pa.Table.from_arrays([*_repeated(key[:1], types, len(found)), t, height, width, x, y], names=[*FRAME, "height", "width", "fx", "fy"])

    types = [_arrow(frames, "media_id")]
    return in_blocks(frames, block).groupBy("media_id", "b").applyInArrow(run, f"{_kinds(frames, ['media_id'])}, frame_idx int, height int, width int, fx array<double>, fy array<double>")


def flow_pixels(flow: DataFrame) -> DataFrame:
    """(media_id, frame_idx, y, x, fx, fy): a row a pixel."""
    cells = flow.select(*FRAME, "width", F.posexplode(F.arrays_zip("fx", "fy")).alias("i", "f"))
    return cells.select(*FRAME, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "f.fx", "f.fy")


def pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    """The image, and each smaller one of half its size."""
    out = [image]
    for _ in range(levels):
        if min(out[-1].shape) < 4:
            break
        out.append(smooth(out[-1], 1.0)[::2, ::2])
    return out


def held(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1.0 where a place is within the image, else 0.0."""
    return ((y >= 0) & (y <= a.shape[0] - 1) & (x >= 0) & (x <= a.shape[1] - 1)).astype(float)


def followed(a: list[np.ndarray], b: list[np.ndarray], points: np.ndarray, window: int, iterations: int = 10, close: float = 0.03, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where points (y, x) of the first pyramid are in the second, whether each is found, and the mean difference of its patches.

    From the smallest level on, Newton steps move a patch of `window` pixels until a step is
    shorter than `close`; pixels outside either image don't count. A point is lost where it leaves the image, or where the lesser
    eigenvalue of its patch's gradients, in 32 gray levels a pixel, squared and averaged, is under `least`.
    """
    r = window // 2
    dy, dx = (d.ravel()[None] for d in np.meshgrid(np.arange(-r, r + 1.0), np.arange(-r, r + 1.0), indexing="ij"))
    guess, found, error = np.zeros_like(points), np.ones(len(points), bool), np.zeros(len(points))
    for level in range(min(len(a), len(b)) - 1, -1, -1):
        first, second = a[level], b[level]
        at, guess = points / 2**level, guess * 2
        gy, gx = np.gradient(first) if min(first.shape) > 1 else (np.zeros_like(first), np.zeros_like(first))
        py, px = at[:, :1] + dy, at[:, 1:] + dx
        patch, iy, ix = (sampled(v, py, px) for v in (first, gy, gx))
        seen = held(first, py, px)
        yy, xx, xy = ((seen * u * v).sum(1) for u, v in ((iy, iy), (ix, ix), (iy, ix)))
        weak = (yy + xx - np.sqrt((yy - xx) ** 2 + 4 * xy * xy)) / 2 / patch.shape[1] / 32**2 < least
        if level == 0:
            found &= ~weak
        moving = np.flatnonzero(~weak)
        for _ in range(iterations):
            if not len(moving):
                break
            y, x, iyk, ixk = py[moving] + guess[moving, :1], px[moving] + guess[moving, 1:], iy[moving], ix[moving]
            both = seen[moving] * held(second, y, x)
            gone = both * (patch[moving] - sampled(second, y, x))
            yy, xx, xy, by, bx = ((both * u * v).sum(1) for u, v in ((iyk, iyk), (ixk, ixk), (iyk, ixk), (gone, iyk), (gone, ixk)))
            det = yy * xx - xy * xy
            step = np.stack([xx * by - xy * bx, yy * bx - xy * by], axis=1) / np.where(det > 1e-9, det, np.inf)[:, None]
            guess[moving] += step
            moving = moving[np.hypot(*step.T) >= close]
        if level == 0 and len(points):
            error = np.abs(patch - sampled(second, py + guess[:, :1], px + guess[:, 1:])).mean(1)
    new = points + guess
    found &= (new >= 0).all(1) & (new <= np.array(b[0].shape) - 1.0).all(1)
    return new, found, error


def tracks(frames: DataFrame, points: DataFrame, window: int = 15, levels: int = 2, iterations: int = 10, close: float = 0.03, least: float = 1e-4, block: int = 512) -> DataFrame:
    """(media_id, track, frame_idx, y, x, error): points (media_id, track, y, x) of each clip's frame 0, followed until they are lost.

    Each step needs the one before, so blocks of frames follow each other, and each block is
    a job over all clips: a task holds one block of a clip and the points that have come so
    far, which a checkpoint carries on. A frame that is missing ends the clip's tracks.
    """
    from ..sources.tables import checkpointed

    kind, types = _kinds(frames, ["media_id"]), [_arrow(frames, "media_id")]
    names = ["media_id", "track", "frame_idx", "y", "x", "error"]
    schema = f"{kind}, track long, frame_idx int, y double, x double, error double"

    def follow(key: tuple, points: pa.Table, rows: pa.Table) -> pa.Table:
        track, at = points.column("track").to_numpy(), np.stack([points.column(c).to_numpy() for c in ("y", "x")], axis=1).astype(float)
        out, last, t = [], None, points.column("frame_idx")[0].as_py() if len(points) else 0
        for k, image in images(rows.sort_by("frame_idx")):
            if not len(track) or last is None and k != t or last is not None and k != t + 1:
                break
            now = pyramid(image, levels)
            if last is not None:
                at, found, error = followed(last, now, at, window, iterations, close, least)
                track, at, error, t = track[found], at[found], error[found], k
                out.append((track, np.full(len(track), k, np.int32), at[:, 0], at[:, 1], error))
            last = now
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(5)]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), *[pa.float64()] * 3), strict=True)]
        return pa.Table.from_arrays([*_repeated(key, types, len(columns[0])), *arrays], names=names)

    last_frame = frames.agg(F.max("frame_idx")).first()[0]
    now = points.select("media_id", F.col("track").cast("long").alias("track"), F.lit(0).alias("frame_idx"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.lit(0.0).alias("error"))
    out = now
    for begin in range(0, last_frame or 0, block):
        part = frames.where(F.col("frame_idx").between(begin, begin + block)).withColumnRenamed("media_id", "clip")
        found = checkpointed(now.groupBy("media_id").cogroup(part.groupBy("clip")).applyInArrow(follow, schema))
        out, now = out.unionByName(found), found.where(F.col("frame_idx") == begin + block)
    return out


def points_of(corners: DataFrame) -> DataFrame:
    """(media_id, track, y, x): the corners (media_id, frame_idx, y, x) of each clip's frame 0, numbered by place."""
    first = corners.where("frame_idx = 0").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("p"))
    return first.select("media_id", F.posexplode("p").alias("track", "p")).select("media_id", "track", "p.y", "p.x")
