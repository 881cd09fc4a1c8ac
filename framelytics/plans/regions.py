"""Queries on whole frames: contours, blurred boxes, adaptive denoising and a detector's maps, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators import detect
from ..operators import frames as P
from ..operators import sphere
from ..operators.flow import frame_rows
from ..sources import adapters as A
from .registry import CLIP, PX, query, r, rounded

PLACED = "frame_idx % 3 AS x1, frame_idx // 3 % 3 AS y1, 3 + frame_idx % 3 AS w, 4 AS h"


def boxes_of(frames):
    """A box for each frame, of a place and size that change with its number."""
    f = F.col("frame_idx")
    x1, y1 = f % 3, F.floor(f / 3) % 3
    return frames.select("media_id", "frame_idx", F.lit(0).alias("box"), x1.alias("x1"), y1.alias("y1"), (x1 + 3 + f % 3).alias("x2"), (y1 + 4).alias("y2"))


def _mirrored(at: str, size: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {size} THEN 2 * ({size} - 1) - ({at}) ELSE {at} END"


@query(f"""WITH {PX}, boxed AS (SELECT *, {PLACED} FROM px),
roi AS (SELECT media_id, frame_idx, y, x, x1, y1, w, h, h // 2 AS ky, w // 2 AS kx FROM boxed WHERE x BETWEEN x1 AND x1 + w - 1 AND y BETWEEN y1 AND y1 + h - 1),
seen AS (SELECT o.*, y1 + {_mirrored('o.y - y1 - ky // 2 + dy', 'h')} AS qy, x1 + {_mirrored('o.x - x1 - kx // 2 + dx', 'w')} AS qx FROM roi o CROSS JOIN range(0, 2) a(dy) CROSS JOIN range(0, 2) b(dx) WHERE dy < ky AND dx < kx),
blurred AS (SELECT s.media_id, s.frame_idx, s.y, s.x, round_even(avg(q.v), 0)::INT AS b FROM seen s JOIN px q ON q.media_id = s.media_id AND q.frame_idx = s.frame_idx AND q.y = s.qy AND q.x = s.qx GROUP BY 1, 2, 3, 4)
SELECT p.media_id, p.frame_idx, p.y, p.x, coalesce(b, v)::INT AS v FROM px p LEFT JOIN blurred USING (media_id, frame_idx, y, x)""")
def blurred_boxes(s, d):
    frames = frame_rows(A.pixels(s, d))
    return R.pixel_rows(R.blur_boxes(frames, boxes_of(frames)))


#: Of the denoising that SQL follows: frames on both sides, and levels.
RADIUS, SINGLE, TOTAL = 4, 51, 153


@query(f"""WITH {PX}, ends AS (SELECT media_id, max(frame_idx) AS last FROM px GROUP BY 1),
looked AS (SELECT p.media_id, p.frame_idx, p.y, p.x, p.v, side, j, 2 * j + side AS e, q.v AS w, abs(p.v - q.v) AS d FROM px p JOIN ends n ON n.media_id = p.media_id CROSS JOIN range(1, {RADIUS + 1}) t(j) CROSS JOIN range(0, 2) u(side) JOIN px q ON q.media_id = p.media_id AND q.y = p.y AND q.x = p.x AND q.frame_idx = CASE WHEN side = 0 THEN greatest(p.frame_idx - j, 0) ELSE least(p.frame_idx + j, n.last) END),
summed AS (SELECT *, sum(d) OVER (PARTITION BY media_id, frame_idx, y, x, side ORDER BY j) AS g FROM looked),
stopped AS (SELECT *, min(e) FILTER (d > {SINGLE} OR g > {TOTAL}) OVER (PARTITION BY media_id, frame_idx, y, x) AS stop FROM summed)
SELECT media_id, frame_idx, y, x, ((v + coalesce(sum(w) FILTER (stop IS NULL OR e < stop), 0) + (1 + count(*) FILTER (stop IS NULL OR e < stop)) // 2) // (1 + count(*) FILTER (stop IS NULL OR e < stop)))::INT AS v FROM stopped GROUP BY media_id, frame_idx, y, x, v""")
def adaptive_denoise(s, d):
    return R.pixel_rows(R.adaptive_denoise(frame_rows(A.pixels(s, d)), RADIUS, SINGLE / 255, TOTAL / 255))


@query()
def contour_area(s, d):
    """The box of the largest contour of what differs from its neighbourhood; tested against filled areas by hand."""
    return rounded(R.contour_box(frame_rows(P.invert(P.adaptive_mean(A.pixels(s, d), 3, 2)))))


def detector_maps(s, d):
    """Maps of 8 x 8 cells from each clip's vectors: every map the vector from another place on."""
    turned = lambda by: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("vec", (i + by) % 64))
    clips = A.clips(s, d)
    return clips.select("media_id", "frame_idx", F.col("vec").alias("heat"), *[turned(by).alias(n) for n, by in (("scale_y", 7), ("scale_x", 13), ("offset_y", 29), ("offset_x", 37))], F.array(*[turned(3 * k) for k in range(10)]).alias("landmark"))


def _mark(k: int, of: str, corner: str) -> str:
    return f"vec[(i + {3 * k}) % 64 + 1]::DOUBLE * {of} + {corner}"


@query(f"""WITH {CLIP}, seen AS (SELECT media_id, frame_idx, i::INT AS box, i, vec, vec[i + 1]::DOUBLE AS score, exp(vec[(i + 7) % 64 + 1]::DOUBLE) * 4 AS h, exp(vec[(i + 13) % 64 + 1]::DOUBLE) * 4 AS w, vec[(i + 29) % 64 + 1]::DOUBLE AS oy, vec[(i + 37) % 64 + 1]::DOUBLE AS ox FROM clip, range(64) t(i) WHERE vec[i + 1]::DOUBLE > 0.2),
cut AS (SELECT *, least(greatest((i % 8 + ox + 0.5) * 4 - w / 2, 0), 32) AS x1, least(greatest((i // 8 + oy + 0.5) * 4 - h / 2, 0), 32) AS y1 FROM seen)
SELECT media_id, frame_idx, box, {r('x1')} AS x1, {r('y1')} AS y1, {r('least(x1 + w, 32)')} AS x2, {r('least(y1 + h, 32)')} AS y2, {r('score')} AS score, {', '.join(f"{r(_mark(2 * j + 1, 'w', 'x1'))} AS lx{j + 1}, {r(_mark(2 * j, 'h', 'y1'))} AS ly{j + 1}" for j in range(5))} FROM cut""")
def detector_decode(s, d):
    return rounded(detect.decode(detector_maps(s, d), 8, 32, 32, 0.2))


def _levels(frames):
    """Pixels with levels as they are, not whole."""
    cells = frames.select("media_id", "frame_idx", "width", F.posexplode("data").alias("i", "v"))
    return cells.select("media_id", "frame_idx", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "v")


@query(f"""WITH {PX}, o AS (SELECT y, x, tan(radians(50)) * ((x + 0.5::DOUBLE) * 2 / 6 - 1) AS a, tan(radians(50)) * 4 / 6 * ((y + 0.5::DOUBLE) * 2 / 4 - 1) AS b FROM range(4) r(y), range(6) c(x)),
turned AS (SELECT y, x, a * cos(radians(30)) + sin(radians(30)) AS vx, b AS vy, cos(radians(30)) - a * sin(radians(30)) AS vz FROM o),
spot AS (SELECT y, x, (atan2(vx, vz) / pi() + 1) / 2 * 8 - 0.5 AS sx, least(greatest((asin(vy / sqrt(vx * vx + vy * vy + vz * vz)) * 2 / pi() + 1) / 2 * 8 - 0.5, 0), 7) AS sy FROM turned),
corner AS (SELECT y, x, least(floor(sy), 6)::INT + j AS qy, ((floor(sx)::INT + i) % 8 + 8) % 8 AS qx, CASE WHEN j = 1 THEN sy - least(floor(sy), 6) ELSE 1 - sy + least(floor(sy), 6) END * CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END AS w FROM spot, range(2) u(j), range(2) v(i))
SELECT p.media_id, p.frame_idx, c.y::INT AS y, c.x::INT AS x, {r('sum(c.w * p.v)', 4)} AS v FROM corner c JOIN px p ON p.y = c.qy AND p.x = c.qx GROUP BY 1, 2, 3, 4""")
def sphere_flat(s, d):
    """A flat view of 100 degrees, turned right by 30, of full-sphere frames."""
    return rounded(_levels(sphere.projected(frame_rows(A.pixels(s, d)), "equirect", "flat", 4, 6, fov=100.0, yaw=30.0)), 4)


@query()
def sphere_cube(s, d):
    """Full-sphere frames as cube maps and back; tested on smooth images."""
    there = sphere.projected(frame_rows(A.pixels(s, d)), "equirect", "cube", 8, 12)
    return rounded(_levels(sphere.projected(there, "cube", "equirect", 8, 8)), 4)
