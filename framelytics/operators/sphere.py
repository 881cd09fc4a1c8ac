"""Views of the full sphere: from any projection to any other, by unit vectors and bilinear samples.

A vector is (x right, y down, z forward). Each projection says which vector a place of its
image shows, and where in its image a vector is; one map of places serves all frames.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import each_image
from .flow import sampled

#: The faces of a cube map by rows of three: right, left, up; down, front, back. Each as its forward, right and down.
FACES = (
    ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
    ((-1, 0, 0), (0, 0, 1), (0, 1, 0)),
    ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ((0, 1, 0), (1, 0, 0), (0, 0, -1)),
    ((0, 0, 1), (1, 0, 0), (0, 1, 0)),
    ((0, 0, -1), (-1, 0, 0), (0, 1, 0)),
)
PROJECTIONS = ("equirect", "flat", "fisheye", "ball", "cube")


def _square(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of each pixel's centre, from -1 to 1 over the image."""
    x, y = (np.arange(width) + 0.5) * 2 / width - 1, (np.arange(height) + 0.5) * 2 / height - 1
    return np.meshgrid(x, y)


def vectors(projection: str, height: int, width: int, fov: float = 90.0) -> np.ndarray:
    """(height, width, 3): the unit vector that each pixel shows; NaN where it shows none. fov: degrees across of flat and fisheye."""
    x, y = _square(height, width)
    if projection == "equirect":
        lon, lat = x * np.pi, y * np.pi / 2
        return np.stack([np.sin(lon) * np.cos(lat), np.sin(lat), np.cos(lon) * np.cos(lat)], axis=-1)
    if projection == "flat":
        reach = np.tan(np.radians(fov) / 2)
        v = np.stack([x * reach, y * reach * height / width, np.ones_like(x)], axis=-1)
    elif projection == "cube":
        v = np.zeros((height, width, 3))
        row, column = (np.minimum(((c + 1) / 2 * n).astype(int), n - 1) for c, n in ((y, 2), (x, 3)))
        u, w = (x + 1) * 3 - 2 * column - 1, (y + 1) * 2 - 2 * row - 1
        for k, (forward, right, down) in enumerate(np.array(FACES, float)):
            own = row * 3 + column == k
            v[own] = forward + u[own, None] * right + w[own, None] * down
    elif projection in ("fisheye", "ball"):
        r = np.hypot(x, y)
        theta = r * np.radians(fov) / 2 if projection == "fisheye" else 2 * np.arcsin(np.minimum(r, 1))
        part = np.divide(np.sin(theta), r, out=np.zeros_like(r), where=r > 0)
        v = np.stack([x * part, y * part, np.cos(theta)], axis=-1)
        v[r > 1] = np.nan
        return v
    else:
        raise ValueError(f"unknown projection {projection}; there are {', '.join(PROJECTIONS)}")
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def places(projection: str, v: np.ndarray, height: int, width: int, fov: float = 90.0) -> tuple[np.ndarray, np.ndarray]:
    """Where (y, x) in an image of this projection each vector is, in pixels from the first one's centre; NaN where it isn't."""
    x, y, z = np.moveaxis(v, -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if projection == "equirect":
            px, py = np.arctan2(x, z) / np.pi, np.arcsin(np.clip(y, -1, 1)) * 2 / np.pi
        elif projection == "flat":
            reach = np.tan(np.radians(fov) / 2)
            px, py = x / z / reach, y / z / reach * width / height
            px = np.where((z > 0) & (abs(px) <= 1) & (abs(py) <= 1), px, np.nan)
        elif projection in ("fisheye", "ball"):
            theta, side = np.arccos(np.clip(z, -1, 1)), np.hypot(x, y)
            r = theta / (np.radians(fov) / 2) if projection == "fisheye" else np.sin(theta / 2)
            px, py = (np.divide(c * r, side, out=np.zeros_like(r), where=side > 0) for c in (x, y))
            px = np.where(r <= 1, px, np.nan)
        elif projection == "cube":
            forward, right, down = np.moveaxis(np.array(FACES, float), 1, 0)
            toward = v @ forward.T
            k = np.nan_to_num(toward, nan=-2.0).argmax(axis=-1)
            most = np.take_along_axis(toward, k[..., None], -1)[..., 0]
            u, w = ((v * axis[k]).sum(-1) / most for axis in (right, down))
            fw, fh = width / 3, height / 2
            inside = lambda c, n: np.clip((c + 1) / 2 * n - 0.5, 0, n - 1)  # noqa: E731  faces next to each other in the image aren't so on the cube
            return k // 3 * fh + inside(w, fh), k % 3 * fw + inside(u, fw)
        else:
            raise ValueError(f"unknown projection {projection}; there are {', '.join(PROJECTIONS)}")
    return np.where(np.isnan(px), np.nan, (py + 1) / 2 * height - 0.5), (px + 1) / 2 * width - 0.5


def turned(v: np.ndarray, yaw: float, pitch: float, roll: float) -> np.ndarray:
    """Vectors seen by a viewer who has turned right, up and clockwise by so many degrees."""
    a, b, c = np.radians([yaw, pitch, roll])
    about_y = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    about_x = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    about_z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return v @ (about_y @ about_x @ about_z).T


@cache
def _map(source: str, target: str, shape: tuple[int, int], size: tuple[int, int], fovs: tuple[float, float], turn: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = places(source, turned(vectors(target, *size, fovs[1]), *turn), *shape, fovs[0])
    shown = ~(np.isnan(y) | np.isnan(x))
    return np.where(shown, y, 0), np.where(shown, x, 0), shown


def projected(frames: DataFrame, source: str, target: str, height: int, width: int, source_fov: float = 180.0, fov: float = 90.0, yaw: float = 0.0, pitch: float = 0.0, roll: float = 0.0) -> DataFrame:
    """frames (as of flow.frame_rows) of one projection in another one, height x width, 0 where the source shows nothing.

    fov is that of a flat or fisheye target, source_fov that of such a source. An
    equirectangular source goes on around; cube faces end at their edges. A process computes
    the map of places once for each size of frames.
    """
    if source not in PROJECTIONS or target not in PROJECTIONS:
        raise ValueError(f"a projection is one of {', '.join(PROJECTIONS)}")

    def run(image: np.ndarray) -> np.ndarray:
        y, x, shown = _map(source, target, image.shape, (height, width), (source_fov, fov), (yaw, pitch, roll))
        if source == "equirect":
            image, x = np.pad(image, ((0, 0), (1, 1)), mode="wrap"), x + 1
        return np.where(shown, sampled(image, y, x), 0.0)

    return each_image(frames, run).withColumns({"height": F.lit(height), "width": F.lit(width)})
