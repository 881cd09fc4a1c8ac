"""Projections there and back, and places that are known."""

import numpy as np
import pytest

from framelytics.operators import sphere
from tests.test_arrays import found
from tests.test_flow import rows_of


def smooth(height, width):
    """Levels of a smooth function of the direction, so that all projections can be compared with it."""
    return level(sphere.vectors("equirect", height, width))


def level(v):
    return 120 + 60 * v[..., 0] * v[..., 2] + 40 * v[..., 1] + 20 * v[..., 0]


@pytest.mark.parametrize("target, size, fov", [("cube", (64, 96), 90.0), ("fisheye", (90, 90), 200.0), ("flat", (60, 80), 100.0), ("ball", (120, 120), 90.0), ("equirect", (50, 100), 90.0)])
def test_each_shows_its_directions(spark, target, size, fov):
    out = found(sphere.projected(rows_of(spark, [smooth(90, 180)] * 2), "equirect", target, *size, fov=fov))
    v = sphere.vectors(target, *size, fov)
    shown = ~np.isnan(v[..., 0])
    for k in range(2):
        assert out[0, k].shape == size and abs(out[0, k] - level(v))[shown].max() < 1 and (out[0, k][~shown] == 0).all()


@pytest.mark.parametrize("other, size, fov", [("cube", (96, 144), 90.0), ("fisheye", (200, 200), 360.0), ("ball", (240, 240), 90.0)])
def test_there_and_back(spark, other, size, fov):
    image = smooth(60, 120)
    there = sphere.projected(rows_of(spark, [image]), "equirect", other, *size, fov=fov)
    back = found(sphere.projected(there, other, "equirect", 60, 120, source_fov=fov))[0, 0]
    away = abs(back - image)
    if other != "cube":  # a circle's rim is a single direction
        away = away[:, 10:-10]
    assert away.max() < 1


def test_turning():
    ahead = np.array([0.0, 0.0, 1.0])
    assert np.allclose(sphere.turned(ahead, 90, 0, 0), [1, 0, 0])
    assert np.allclose(sphere.turned(ahead, 0, 90, 0), [0, -1, 0])
    assert np.allclose(sphere.turned(np.array([1.0, 0, 0]), 0, 0, 90), [0, 1, 0])


def test_vectors_and_places_agree():
    for p in sphere.PROJECTIONS:
        v = sphere.vectors(p, 30, 42, 100.0)
        y, x = sphere.places(p, v, 30, 42, 100.0)
        rows, columns = np.mgrid[:30, :42]
        shown = ~np.isnan(y)
        assert np.allclose(y[shown], rows[shown], atol=1e-6) and np.allclose(x[shown], columns[shown], atol=1e-6) and shown.mean() > 0.6


def test_unknown(spark):
    with pytest.raises(ValueError, match="projection"):
        sphere.projected(rows_of(spark, [np.zeros((4, 8))]), "equirect", "cone", 4, 4)
