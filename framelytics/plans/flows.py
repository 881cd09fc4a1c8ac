"""Queries on dense flow and followed points, with DuckDB SQL where SQL can follow them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import colour as C
from ..operators import flow as O
from ..operators import frames as P
from ..operators import series as S
from ..sources import adapters as A
from .registry import PX, query, r, rounded

#: Of the query that SQL follows: half the width of the fit, its bell and the window.
N, SIGMA, WINDOW = 1, 1.2, 3


def _fit() -> str:
    """SQL values (dy, dx, and the weight of that pixel in the terms x, y, xx, yy, xy) of the weighted least squares, from its normal equations."""
    dy, dx = (d.ravel() for d in np.meshgrid(np.arange(-N, N + 1), np.arange(-N, N + 1), indexing="ij"))
    bell = np.exp(-0.5 * (dx**2 + dy**2) / SIGMA**2)
    basis = np.stack([dx**0, dx, dy, dx**2, dy**2, dx * dy], axis=1).astype(float)
    fit = np.linalg.solve(basis.T @ (basis * bell[:, None]), (basis * bell[:, None]).T)[1:]
    return "(VALUES " + ", ".join(f"({y}, {x}, " + ", ".join(f"{v!r}::DOUBLE" for v in column.tolist()) + ")" for y, x, column in zip(dy.tolist(), dx.tolist(), fit.T, strict=True)) + ") w(dy, dx, wx, wy, wxx, wyy, wxy)"


def _near(at: str, by: str) -> str:
    return f"least(greatest({at} + {by}, 0), 7)"


FITTED = f"""WITH {PX}, coef AS (SELECT p.media_id, p.frame_idx, p.y, p.x, sum(q.v * wx) AS bx, sum(q.v * wy) AS by_, sum(q.v * wxx) AS xx, sum(q.v * wyy) AS yy, sum(q.v * wxy) / 2 AS xy FROM px p CROSS JOIN {_fit()} JOIN px q ON q.media_id = p.media_id AND q.frame_idx = p.frame_idx AND q.y = {_near('p.y', 'dy')} AND q.x = {_near('p.x', 'dx')} GROUP BY 1, 2, 3, 4),
paired AS (SELECT a.media_id, a.frame_idx, a.y, a.x, (a.xx + b.xx) / 2 AS xx, (a.yy + b.yy) / 2 AS yy, (a.xy + b.xy) / 2 AS xy, (a.bx - b.bx) / 2 AS dx, (a.by_ - b.by_) / 2 AS dy FROM coef a JOIN coef b ON b.media_id = a.media_id AND b.frame_idx = a.frame_idx + 1 AND b.y = a.y AND b.x = a.x),
terms AS (SELECT media_id, frame_idx, y, x, xx * xx + xy * xy AS g11, xy * (xx + yy) AS g12, xy * xy + yy * yy AS g22, xx * dx + xy * dy AS h1, xy * dx + yy * dy AS h2 FROM paired),
sums AS (SELECT p.media_id, p.frame_idx, p.y, p.x, avg(g11) + 1e-9 AS g11, avg(g12) AS g12, avg(g22) + 1e-9 AS g22, avg(h1) AS h1, avg(h2) AS h2 FROM (SELECT media_id, frame_idx, y, x FROM terms) p CROSS JOIN range(-1, 2) u(dy) CROSS JOIN range(-1, 2) v(dx) JOIN terms q ON q.media_id = p.media_id AND q.frame_idx = p.frame_idx AND q.y = {_near('p.y', 'u.dy')} AND q.x = {_near('p.x', 'v.dx')} GROUP BY 1, 2, 3, 4)
SELECT media_id, frame_idx, y, x, {r('(g22 * h1 - g12 * h2) / (g11 * g22 - g12 * g12)', 4)} AS fx, {r('(g11 * h2 - g12 * h1) / (g11 * g22 - g12 * g12)', 4)} AS fy FROM sums"""


def flow(s, d):
    return O.dense_flow(O.frame_rows(A.pixels(s, d)), n=2, window=5)


@query(FITTED)
def dense_flow_step(s, d):
    """One step of one level, as SQL can state it."""
    return rounded(O.flow_pixels(O.dense_flow(O.frame_rows(A.pixels(s, d)), levels=0, window=WINDOW, iterations=1, n=N, sigma=SIGMA)), 4)


@query()
def dense_flow(s, d):
    """Tested on known shifts and zooms."""
    return rounded(O.flow_pixels(flow(s, d)), 4)


@query()
def dense_flow_impacts(s, d):
    """Impacts of the envelope over directograms of dense flow."""
    directograms = P.directogram(O.flow_pixels(flow(s, d)), 16)
    return rounded(S.impacts(S.impact_envelope(directograms, 16, 3), 5, 5))


@query()
def point_tracks(s, d):
    """Corners of each clip's first frame, followed over image pyramids; tested on moving squares."""
    px = A.pixels(s, d)
    corners = C.corners(px.where(F.col("frame_idx") == 0), 3, 20, 0.1, 2.0)
    return rounded(O.tracks(O.frame_rows(px), O.points_of(corners), window=5, levels=1), 3)
