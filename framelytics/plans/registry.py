"""The reference's operators as named queries, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import frames as P
from ..operators import series as S
from ..operators import spectra as T
from ..sources import adapters as A
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
W = H = A.SIDE
FPS = 25.0

CLIP = "clip AS (SELECT label AS media_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_idx, embedding AS vec FROM embeddings)"
PX = f"{CLIP}, px AS (SELECT media_id, frame_idx, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, floor(least(greatest((vec[i]::DOUBLE + 0.5) * 255, 0), 255))::INT AS v FROM clip, range(1, 65) t(i))"
DIFF = f"{PX}, lagged AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx)) AS d FROM px), diff AS (SELECT media_id, frame_idx - 1 AS frame_idx, y, x, d AS v FROM lagged WHERE d IS NOT NULL)"
MOT = f"""{DIFF}, hot AS (SELECT media_id, frame_idx, y, x, CASE WHEN v > 0.05 * 255 THEN v ELSE 0 END AS v FROM diff),
 mot AS (SELECT media_id, frame_idx, y + dy AS y, x + dx AS x, (list_sort(list_concat(list(v), list_resize([]::INT[], 9 - count(*), 0)))[5])::INT AS v FROM hot, (SELECT unnest(range(-1, 2))::INT AS dy), (SELECT unnest(range(-1, 2))::INT AS dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4)"""
SIG = "sig AS (SELECT user_id AS media_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS n, ts, value AS y FROM events)"
GRAM = f"{MOT}, lines AS (SELECT media_id, frame_idx + 1 AS frame_idx, x AS pos, floor(avg(v))::INT AS v FROM mot GROUP BY 1, 2, 3), gram AS (SELECT * FROM lines UNION ALL SELECT DISTINCT media_id, 0, pos, 0 FROM lines)"
BOX = "box AS (SELECT l_orderkey AS frame_idx, l_linenumber AS box, l_quantity AS x1, l_linenumber::DOUBLE AS y1, l_quantity + floor(l_discount * 100) AS x2, l_linenumber + floor(l_tax * 100) AS y2, l_extendedprice AS score FROM lineitem)"
FLOW = f"""{PX}, g AS (SELECT *, (lead(v) OVER (PARTITION BY media_id, frame_idx, y ORDER BY x) - lag(v) OVER (PARTITION BY media_id, frame_idx, y ORDER BY x)) / 2.0 AS ix,
 (lead(v) OVER (PARTITION BY media_id, frame_idx, x ORDER BY y) - lag(v) OVER (PARTITION BY media_id, frame_idx, x ORDER BY y)) / 2.0 AS iy,
 lead(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx) - v AS it FROM px),
flow AS (SELECT media_id, frame_idx, y, x, CASE WHEN ix*ix + iy*iy > 0 THEN -it * ix::DOUBLE / (ix*ix + iy*iy) ELSE 0 END + 0.0 AS fx, CASE WHEN ix*ix + iy*iy > 0 THEN -it * iy::DOUBLE / (ix*ix + iy*iy) ELSE 0 END + 0.0 AS fy FROM g WHERE it IS NOT NULL)"""


def near(k: int, value: str, table: str = "px") -> str:
    """SQL rows of an aggregate over the k x k neighbourhood inside the frame."""
    r = k // 2
    return f"SELECT media_id, frame_idx, y + dy AS y, x + dx AS x, {value} AS v FROM {table}, (SELECT unnest(range({-r}, {r + 1}))::INT AS dy), (SELECT unnest(range({-r}, {r + 1}))::INT AS dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits from plan to plan."""
    return df.select([(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def moved(s: SparkSession, d: str) -> DataFrame:
    """The motion chain: difference, threshold, median."""
    return P.median(P.threshold(P.difference(A.pixels(s, d)), 0.05), 3)


@query(f"WITH {MOT}, m AS (SELECT media_id, frame_idx, sum(v)::BIGINT AS q, sum(x*v)::DOUBLE AS sx, sum(y*v)::DOUBLE AS sy FROM mot GROUP BY 1, 2) SELECT media_id, frame_idx, round_even(frame_idx / 25.0 * 1000, 0)::BIGINT AS \"Time\", q AS \"Qom\", {r('CASE WHEN q > 0 THEN sx / q ELSE 0 END / 8')} AS \"ComX\", {r('(8 - CASE WHEN q > 0 THEN sy / q ELSE 0 END) / 8')} AS \"ComY\" FROM m")
def motion_qom_com(s, d):
    return rounded(P.motion(moved(s, d), W, H, FPS))


@query(f"WITH {MOT}, m AS (SELECT media_id, frame_idx, sum(v) AS q FROM mot GROUP BY 1, 2) SELECT media_id, frame_idx, {r('coalesce(q::DOUBLE / nullif(max(q) OVER (PARTITION BY media_id), 0), 0)')} AS qom FROM m")
def motion_qom_norm(s, d):
    return rounded(P.normalised_qom(P.motion(moved(s, d), W, H, FPS)).select("media_id", "frame_idx", F.col("Qom").alias("qom")))


@query(f"WITH {DIFF} SELECT * FROM diff")
def frame_diff(s, d):
    return P.difference(A.pixels(s, d))


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, CASE WHEN v > 0.5 * 255 THEN v ELSE 0 END AS v FROM px")
def thresh_regular(s, d):
    return P.threshold(A.pixels(s, d), 0.5)


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, CASE WHEN v > 0.5 * 255 THEN 255 ELSE 0 END AS v FROM px")
def thresh_binary(s, d):
    return P.threshold(A.pixels(s, d), 0.5, True)


@query(f"WITH {PX} {near(3, 'min(v)')}")
def erode3(s, d):
    return P.erode(A.pixels(s, d), 3)


@query(f"WITH {PX} {near(3, 'list_sort(list_concat(list(v), list_resize([]::INT[], 9 - count(*), 0)))[5]')}")
def median3(s, d):
    return P.median(A.pixels(s, d), 3)


@query(f"WITH {PX} {near(5, '(sum(v) // count(*))::INT')}")
def box_blur(s, d):
    return P.box_blur(A.pixels(s, d), 5)


ROWS = "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING"


@query(f"WITH {PX}, a AS (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY media_id, frame_idx, y ORDER BY x {ROWS})), m AS (SELECT *, sum(s) OVER w / sum(n) OVER w AS mean FROM a WINDOW w AS (PARTITION BY media_id, frame_idx, x ORDER BY y {ROWS})) SELECT media_id, frame_idx, y, x, CASE WHEN v > mean - 2 THEN 255 ELSE 0 END AS v FROM m")
def adaptive_mean(s, d):
    return P.adaptive_mean(A.pixels(s, d), 3, 2)


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, 255 - v AS v FROM px")
def invert(s, d):
    return P.invert(A.pixels(s, d))


@query(f"WITH {PX} SELECT media_id, frame_idx - 10 AS frame_idx, y, x, v FROM px WHERE frame_idx >= 10 AND frame_idx < 25")
def trim(s, d):
    return P.trim(A.pixels(s, d), 1.0, 0.4, FPS)


@query(f"WITH {PX} SELECT media_id, (frame_idx // 3)::INT AS frame_idx, y, x, v FROM px WHERE frame_idx % 3 = 0")
def skip(s, d):
    return P.skip(A.pixels(s, d), 2)


@query(f"WITH {PX}, n AS (SELECT media_id, max(frame_idx) + 1 AS n FROM px GROUP BY 1), k AS (SELECT media_id, k, (k * n // 20)::INT AS f FROM n, (SELECT unnest(range(20))::INT AS k)) SELECT px.media_id, k AS frame_idx, y, x, v FROM k JOIN px ON px.media_id = k.media_id AND px.frame_idx = f")
def fixed_frames(s, d):
    return P.fixed_frames(A.pixels(s, d), 20)


@query(f"WITH {PX} SELECT media_id, frame_idx, x AS y, 7 - y AS x, v FROM px")
def rotate90(s, d):
    return P.rotate90(A.pixels(s, d), H)


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, floor(least(greatest(v * (1.27::DOUBLE * 20 / 127 + 1) - 1.27::DOUBLE * 20 + 2.55::DOUBLE * 10, 0), 255))::INT AS v FROM px")
def contrast(s, d):
    return P.contrast(A.pixels(s, d), 20, 10)


@query(f"WITH {PX} SELECT media_id, frame_idx, y - 1 AS y, x - 2 AS x, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3")
def crop(s, d):
    return P.crop(A.pixels(s, d), 4, 3, 2, 1)


@query(f"WITH {DIFF} SELECT media_id, greatest(0, min(x) - 4) AS x1, greatest(0, min(y) - 4) AS y1, least(7, max(x) + 4) AS x2, least(7, max(y) + 4) AS y2 FROM diff WHERE v > 0.2 * 255 GROUP BY 1")
def motion_box(s, d):
    return P.motion_box(A.pixels(s, d), 0.2, 3, W, H)


@query(f"WITH {PX}, n AS (SELECT media_id, greatest(1, (max(frame_idx) + 1) // 9)::INT AS n FROM px GROUP BY 1) SELECT media_id, frame_idx, (frame_idx // n // 3)::INT AS row, ((frame_idx // n) % 3)::INT AS col, y, x, v FROM px JOIN n USING (media_id) WHERE frame_idx % n = 0 AND frame_idx / n < 9")
def grid_sample(s, d):
    return P.grid_sample(A.pixels(s, d), 3, 3)


@query(f"WITH {PX}, bg AS (SELECT media_id, y, x, floor(avg(v))::INT AS b FROM px GROUP BY 1, 2, 3) SELECT media_id, frame_idx, y, x, CASE WHEN abs(v - b) > 0.1 * 255 THEN v ELSE 0 END AS v FROM px JOIN bg USING (media_id, y, x)")
def bg_subtract(s, d):
    return P.subtract_background(A.pixels(s, d), 0.1)


@query(f"WITH {GRAM} SELECT * FROM gram")
def motiongram_x(s, d):
    return P.motiongram(moved(s, d), "x")


@query(f"WITH {GRAM.replace('x AS pos', 'y AS pos')} SELECT * FROM gram")
def motiongram_y(s, d):
    return P.motiongram(moved(s, d), "y")


@query(f"WITH {GRAM}, e AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM gram GROUP BY 1) SELECT media_id, frame_idx, pos, CASE WHEN hi > lo THEN floor((v - lo) * 255.0 / (hi - lo)) ELSE 0 END::INT AS v FROM gram JOIN e USING (media_id)")
def gram_minmax(s, d):
    return P.gram_minmax(P.motiongram(moved(s, d), "x"))


@query(f"WITH {GRAM}, c AS (SELECT media_id, v, count(*) AS n FROM gram GROUP BY 1, 2), f AS (SELECT media_id, v, sum(n) OVER w AS cdf, first(n) OVER w AS low, sum(n) OVER (PARTITION BY media_id) AS n FROM c WINDOW w AS (PARTITION BY media_id ORDER BY v)) SELECT media_id, frame_idx, pos, CASE WHEN n > low THEN round(255 * (cdf - low)::DOUBLE / (n - low)) ELSE v END::INT AS v FROM gram JOIN f USING (media_id, v)")
def equalize(s, d):
    return P.equalise(P.motiongram(moved(s, d), "x"))


@query(f"WITH {PX} SELECT media_id, frame_idx, x AS pos, {r('avg(v)')} AS v FROM px GROUP BY 1, 2, 3")
def videogram_x(s, d):
    return rounded(P.videogram(A.pixels(s, d), "x"))


@query(f"WITH {PX} SELECT media_id, frame_idx, y AS pos, {r('avg(v)')} AS v FROM px GROUP BY 1, 2, 3")
def videogram_y(s, d):
    return rounded(P.videogram(A.pixels(s, d), "y"))


@query(f"WITH {PX} SELECT media_id, (frame_idx // 16)::INT AS row, frame_idx % 16 AS col, floor(avg(v))::INT AS v FROM px GROUP BY media_id, frame_idx")
def pixelarray(s, d):
    return P.pixel_array(A.pixels(s, d), 16)


@query(f"WITH {PX} SELECT media_id, y, x, {r('avg(v)')} AS average, max(v) AS lighten, min(v) AS darken FROM px GROUP BY 1, 2, 3")
def blend(s, d):
    return rounded(P.blend(A.pixels(s, d)))


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, floor(avg(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx ROWS 3 PRECEDING))::INT AS v FROM px")
def history_equal(s, d):
    return P.history(A.pixels(s, d), [1.0] * 4)


@query(f"WITH {PX}, l AS (SELECT *, array_agg(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM px) SELECT media_id, frame_idx, y, x, CASE WHEN b IS NULL THEN v ELSE floor((2.0::DOUBLE * v + 1.5::DOUBLE * b[1] + coalesce(b[2], 0) + coalesce(b[3], 0)) / 5.5)::INT END AS v FROM l")
def history_weighted(s, d):
    """Up to three frames before; the second weight is the oldest one's."""
    return P.exact_history(A.pixels(s, d), 3, [2.0, 1.5])


@query(f"WITH {MOT} SELECT media_id, frame_idx, y, x, floor(avg(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx ROWS 3 PRECEDING))::INT AS v FROM mot")
def motion_history(s, d):
    return P.motion_history(moved(s, d), 3)


@query(f"WITH {PX}, m AS (SELECT *, floor(avg(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))::INT AS m FROM px) SELECT media_id, frame_idx, y, x, CASE WHEN abs(m - v) < 20 THEN m ELSE v END AS v FROM m")
def denoise(s, d):
    return P.denoise(A.pixels(s, d), 2, 20)


@query(f"WITH {PX}, b AS ({near(3, '(sum(v) // count(*))::INT')}) SELECT media_id, frame_idx, {r('CASE WHEN sum((px.v - b.v) ** 2) > 0 THEN 10 * log10(65025.0 / avg((px.v - b.v) ** 2)) END')} AS psnr FROM px JOIN b USING (media_id, frame_idx, y, x) GROUP BY 1, 2")
def psnr(s, d):
    px = A.pixels(s, d)
    return rounded(P.psnr(px, P.box_blur(px, 3)))


@query(f"WITH {PX}, b AS ({near(3, '(sum(v) // count(*))::INT')}), l AS (SELECT media_id, abs(v - lag(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx)) AS d FROM b) SELECT media_id, {r('avg(d)')} AS score FROM l GROUP BY 1")
def motion_score(s, d):
    return rounded(P.motion_score(A.pixels(s, d), 3))


@query(f"WITH {PX}, b AS ({near(3, '(sum(v) // count(*))::INT')}), k AS (SELECT px.media_id, px.frame_idx, i, j, avg(px.v) AS m, avg(b.v) AS n, avg(px.v * px.v) - avg(px.v) ** 2 AS vv, avg(b.v * b.v) - avg(b.v) ** 2 AS ww, avg(px.v * b.v) - avg(px.v) * avg(b.v) AS vw FROM px JOIN b USING (media_id, frame_idx, y, x), range(3) t(i), range(3) u(j) WHERE y BETWEEN 2 * i AND 2 * i + 3 AND x BETWEEN 2 * j AND 2 * j + 3 GROUP BY 1, 2, 3, 4) SELECT media_id, frame_idx, {r('avg((2 * m * n + 6.5025) * (2 * vw + 58.5225) / ((m * m + n * n + 6.5025) * (vv + ww + 58.5225)))')} AS ssim FROM k GROUP BY 1, 2")
def ssim(s, d):
    px = A.pixels(s, d)
    return rounded(P.ssim(px, P.box_blur(px, 3), W, H, 4, 2))


BRIGHT = f"{PX}, bright AS (SELECT media_id, frame_idx, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM px WHERE v > 180 GROUP BY 1, 2)"


def bright_boxes(s, d):
    return A.pixels(s, d).where("v > 180").groupBy("media_id", "frame_idx").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


@query(f"WITH {BRIGHT} SELECT media_id, frame_idx, y, x, CASE WHEN x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 THEN 0 ELSE v END AS v FROM px LEFT JOIN bright USING (media_id, frame_idx)")
def mask_rectangle(s, d):
    return P.mask_boxes(A.pixels(s, d), bright_boxes(s, d))


@query(f"WITH {BRIGHT}, q AS (SELECT *, (x - (x1 + x2) / 2) ** 2 AS xx, (y - (y1 + y2) / 2) ** 2 AS yy, ((x2 - x1) * 0.75) ** 2 AS rx, ((y2 - y1) * 0.75) ** 2 AS ry FROM px LEFT JOIN bright USING (media_id, frame_idx)) SELECT media_id, frame_idx, y, x, CASE WHEN xx * ry + yy * rx <= rx * ry THEN 128 ELSE v END AS v FROM q")
def mask_ellipse(s, d):
    return P.mask_boxes(A.pixels(s, d), bright_boxes(s, d), 128, True, 1.5)


@query(f"WITH {PX}, o AS (SELECT y::INT AS y, x::INT AS x, ((x + 0.5::DOUBLE) * 2 / 6 - 1) * tan(radians(90.0) / 2) AS a, ((y + 0.5::DOUBLE) * 2 / 4 - 1) * tan(radians(90.0) / 2) * 4 / 6 AS b FROM range(4) t(y), range(6) u(x)), p AS (SELECT y, x, ((floor(((atan2(a, 1) + radians(20.0)) / (2 * pi()) + 0.5) * 8)::INT % 8 + 8) % 8)::INT AS sx, least(7, floor((atan2(b, sqrt(a * a + 1)) / pi() + 0.5) * 8))::INT AS sy FROM o) SELECT media_id, frame_idx, p.y, p.x, v FROM p JOIN px ON px.y = sy AND px.x = sx")
def equirect_to_flat(s, d):
    return P.equirect_to_flat(A.pixels(s, d), W, H, 6, 4, 90.0, 20.0)


@query(f"WITH {FLOW}, z AS (SELECT media_id, frame_idx, y, x, coalesce(ix, 0) AS ix, coalesce(iy, 0) AS iy, it FROM g WHERE it IS NOT NULL), q AS ({near(5, 'struct_pack(xx := sum(ix * ix), xy := sum(ix * iy), yy := sum(iy * iy), xt := sum(ix * it), yt := sum(iy * it), det := sum(ix * ix) * sum(iy * iy) - sum(ix * iy) ** 2)', 'z')}) SELECT media_id, frame_idx, y, x, {r('CASE WHEN v.det > 1e-6 THEN (v.xy * v.yt - v.yy * v.xt) / v.det ELSE 0 END')} AS fx, {r('CASE WHEN v.det > 1e-6 THEN (v.xy * v.xt - v.xx * v.yt) / v.det ELSE 0 END')} AS fy FROM q")
def window_flow(s, d):
    return rounded(P.window_flow(A.pixels(s, d), 5))


@query(f"""WITH RECURSIVE {MOT}, mean AS ({near(5, 'avg(v)', 'mot')}), o AS (SELECT media_id, frame_idx, y, x, y * 8 + x AS p FROM mot JOIN mean m USING (media_id, frame_idx, y, x) WHERE mot.v <= m.v - 2),
 reach AS (SELECT media_id, frame_idx, p AS root, p, y, x FROM o UNION SELECT r.media_id, r.frame_idx, r.root, o.p, o.y, o.x FROM reach r JOIN o ON r.media_id = o.media_id AND r.frame_idx = o.frame_idx AND abs(r.y - o.y) <= 1 AND abs(r.x - o.x) <= 1),
 area AS (SELECT media_id, frame_idx, p, any_value(y) AS y, any_value(x) AS x, min(root) AS root FROM reach GROUP BY 1, 2, 3),
 boxes AS (SELECT media_id, frame_idx, root, count(*) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM area GROUP BY 1, 2, 3),
 best AS (SELECT media_id, frame_idx, arg_max(boxes, n * 100 - root) AS b FROM boxes GROUP BY 1, 2)
 SELECT media_id, frame_idx, coalesce(b.x1 / 8, 0.0) AS "AomX1", coalesce(b.y1 / 8, 0.0) AS "AomY1", coalesce((b.x2 + 1) / 8, 0.0) AS "AomX2", coalesce((b.y2 + 1) / 8, 0.0) AS "AomY2" FROM (SELECT DISTINCT media_id, frame_idx FROM mot) LEFT JOIN best USING (media_id, frame_idx)""")
def motion_area(s, d):
    return P.motion_area(moved(s, d), 5, 2, W, H)


@query(f"WITH {FLOW}, m AS (SELECT media_id, frame_idx, atan2(fy, fx) AS a, sqrt(fx*fx + fy*fy) AS l FROM flow WHERE fx <> 0 OR fy <> 0), e AS (SELECT list(-pi() + k * 2 * pi() / 99 ORDER BY k) AS es FROM range(99) t(k)) SELECT media_id, frame_idx, len(list_filter(es, lambda z: z <= a))::INT AS bin, {r('sum(l)')} AS mag FROM m, e GROUP BY 1, 2, 3")
def directogram(s, d):
    return rounded(P.directogram(P.gradient_flow(A.pixels(s, d))))


@query(f"WITH {FLOW} SELECT media_id, frame_idx, {r('sum(fx) / count(*)')} AS vx, {r('sum(fy) / count(*)')} AS vy FROM flow GROUP BY 1, 2")
def flow_velocity(s, d):
    return rounded(P.flow_velocity(P.gradient_flow(A.pixels(s, d))))


@query(f"WITH {FLOW}, v AS (SELECT media_id, frame_idx, sqrt((sum(fx) / count(*)) ** 2 + (sum(fy) / count(*)) ** 2) AS v FROM flow GROUP BY 1, 2), a AS (SELECT media_id, lead(v) OVER (PARTITION BY media_id ORDER BY frame_idx) * 25 AS a FROM v), p AS (SELECT media_id, a, a / nullif(sum(a) OVER (PARTITION BY media_id), 0) AS p FROM a WHERE a IS NOT NULL) SELECT media_id, {r('avg(a)')} AS mean, {r('sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)')} AS entropy FROM p GROUP BY 1")
def flow_accel_entropy(s, d):
    return rounded(P.flow_acceleration(P.flow_velocity(P.gradient_flow(A.pixels(s, d))), FPS))


@query(f"WITH {SIG}, q AS (SELECT media_id, n, y / max(y) OVER (PARTITION BY media_id) AS q FROM sig WHERE n >= 1), p AS (SELECT media_id, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.5) AS q2, quantile_cont(q, 0.75) AS q3, arg_min(q, n) AS f, arg_max(q, n) AS l FROM q GROUP BY 1) SELECT media_id, {r('q1')} AS q1, {r('q2')} AS q2, {r('q3')} AS q3, {r('least(greatest(q1 - 1.5 * (q3 - q1), f), q1)')} AS lower, {r('least(greatest(q3 + 1.5 * (q3 - q1), q3), l)')} AS upper FROM p")
def qom_quartiles(s, d):
    return rounded(S.quartiles(A.signal(s, d)))


@query(f"WITH {SIG}, z AS (SELECT media_id, n, sum(y) OVER (PARTITION BY media_id ORDER BY n ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) / 41 AS y FROM sig) SELECT media_id, (n // 10)::INT AS n, {r('y')} AS y FROM z WHERE n % 10 = 0")
def smooth_downsample(s, d):
    return rounded(S.smooth_downsample(A.signal(s, d), 41, 10))


@query(f"WITH {SIG}, z AS (SELECT *, (avg(y) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) + avg(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) / 2 AS m, greatest(max(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS near, max(y) OVER (PARTITION BY media_id) AS top, count(*) OVER (PARTITION BY media_id) AS len FROM sig WINDOW w AS (PARTITION BY media_id ORDER BY n)) SELECT media_id, n, y FROM z WHERE n >= 7 AND n < len - 7 AND y > near AND y - m > 0.1 * top")
def impact_detect(s, d):
    return S.impacts(A.signal(s, d), 2, 3)


BEATS = f"{SIG}, beats AS (SELECT media_id, n FROM sig WHERE y > 150)"


def beats(s, d):
    return A.signal(s, d).where("y > 150").select("media_id", "n")


@query(f"WITH {BEATS}, len AS (SELECT media_id, count(*) AS len FROM sig GROUP BY 1), k AS (SELECT media_id, n, row_number() OVER (PARTITION BY media_id ORDER BY n) - 1 AS k FROM beats), z AS (SELECT media_id, k, n, n - lag(n, 1, 0) OVER (PARTITION BY media_id ORDER BY n) AS step FROM k UNION ALL SELECT media_id, max(k) + 1, NULL, any_value(len) - max(n) FROM k JOIN len USING (media_id) GROUP BY 1) SELECT media_id, k::BIGINT AS k, n, step::BIGINT AS step, sum(step) OVER (PARTITION BY media_id ORDER BY k)::BIGINT AS total FROM z")
def beat_intervals(s, d):
    """The first beat, steps between beats and what is left after the last, with their running sum."""
    lengths = A.signal(s, d).groupBy("media_id").agg(F.count("*").alias("len"))
    return S.intervals(beats(s, d), lengths)


@query(f"WITH clicks AS (SELECT user_id AS media_id, ts, event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)), views AS (SELECT user_id AS media_id, ts, max(value) AS v FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1, 2) SELECT c.media_id, c.event_id, v.v FROM clicks c ASOF LEFT JOIN views v ON c.media_id = v.media_id AND c.ts >= v.ts")
def asof_align(s, d):
    e = A.table(s, d, "events").withColumnRenamed("user_id", "media_id")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    both = e.join(F.broadcast(ends))  # one row
    left = both.where("event_type = lo").select("media_id", "ts", "event_id")
    right = both.where("event_type = hi").groupBy("media_id", "ts").agg(F.max("value").alias("v"))
    return S.asof(left, right).select("media_id", "event_id", "v")


@query(f"WITH {BEATS}, seg AS (SELECT media_id, n AS v0, lead(n) OVER (PARTITION BY media_id ORDER BY n) AS v1, (row_number() OVER (PARTITION BY media_id ORDER BY n) - 1) * 4 AS a0 FROM beats), o AS (SELECT media_id, (a0 + k)::INT AS t, round_even(v0 + k * (v1 - v0) / 4.0, 0)::INT AS n FROM seg, range(4) q(k) WHERE v1 IS NOT NULL) SELECT media_id, n, t, y FROM o JOIN sig USING (media_id, n)")
def warp_resample(s, d):
    order = Window.partitionBy("media_id").orderBy("n")
    k = (F.row_number().over(order) - 1) * 4
    seg = beats(s, d).select("media_id", k.alias("a0"), (k + 4).alias("a1"), F.col("n").alias("v0"), F.lead("n").over(order).alias("v1")).where("v1 IS NOT NULL")
    return S.warp_resample(A.signal(s, d), seg)


@query(f"WITH {SIG}, c AS (SELECT media_id, count(*) AS c FROM sig GROUP BY 1), o AS (SELECT media_id, t::INT AS t, (t % c)::INT AS n FROM c, range(120) q(t)) SELECT media_id, n, t, y FROM o JOIN sig USING (media_id, n)")
def audio_loop(s, d):
    return S.loop_extend(A.signal(s, d), 120)


@query(f"WITH {SIG}, b AS (SELECT media_id, (n // 8)::INT AS block, min(y) AS lo, max(y) AS hi, min(n) FILTER (y = lo0) AS a, min(n) FILTER (y = hi0) AS z FROM (SELECT *, min(y) OVER (PARTITION BY media_id, n // 8) AS lo0, max(y) OVER (PARTITION BY media_id, n // 8) AS hi0 FROM sig) GROUP BY 1, 2) SELECT media_id, block, CASE WHEN a <= z THEN lo ELSE hi END AS first, CASE WHEN a <= z THEN hi ELSE lo END AS second FROM b")
def waveform_peaks(s, d):
    return S.waveform_peaks(A.signal(s, d), 8)


SPEC = f"{CLIP}, spec AS (SELECT media_id, frame_idx, k::INT AS k, sqrt(sum(w * cos(2 * pi() * k * i / 64)) ** 2 + sum(w * sin(2 * pi() * k * i / 64)) ** 2) AS mag FROM (SELECT media_id, frame_idx, i, vec[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS w FROM clip, range(64) t(i)), range(33) u(k) GROUP BY 1, 2, 3)"


@query(f"WITH {SPEC} SELECT media_id, frame_idx, k, {r('mag')} AS mag FROM spec")
def stft_mag(s, d):
    return rounded(S.stft(A.clips(s, d), 64))


@query(f"WITH {SPEC}, c AS (SELECT media_id, frame_idx, sum(k * mag) / sum(mag) AS c, sum(mag) AS t, exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)) AS flat FROM spec GROUP BY 1, 2), u AS (SELECT *, sum(mag) OVER (PARTITION BY media_id, frame_idx ORDER BY k) AS run FROM spec) SELECT media_id, frame_idx, {r('any_value(c)')} AS centroid, {r('sqrt(sum(mag / t * (k - c) ** 2))')} AS bandwidth, {r('any_value(flat)')} AS flatness, min(k) FILTER (run >= 0.85 * t) AS rolloff FROM u JOIN c USING (media_id, frame_idx) GROUP BY 1, 2")
def spectral_descriptors(s, d):
    return rounded(S.spectral(S.stft(A.clips(s, d), 64)))


@query(f"WITH {SPEC} SELECT media_id, frame_idx, k, {r('greatest(10 * log10(greatest(1e-10, mag * mag) / greatest(1e-10, max(mag * mag) OVER (PARTITION BY media_id))), -80)', 4)} AS db FROM spec")
def power_db(s, d):
    return rounded(S.power_db(S.stft(A.clips(s, d), 64)), 4)


@query(f"WITH {SPEC}, q AS (SELECT media_id, frame_idx, k, greatest(10 * log10(greatest(1e-10, mag * mag) / greatest(1e-10, max(mag * mag) OVER (PARTITION BY media_id))), -80) AS db FROM spec), z AS (SELECT media_id, frame_idx, coalesce(greatest(db - lag(db) OVER (PARTITION BY media_id, k ORDER BY frame_idx), 0), 0) AS e FROM q) SELECT media_id, frame_idx, {r('avg(e)', 4)} AS onset FROM z GROUP BY 1, 2")
def onset_strength(s, d):
    return rounded(S.onset_strength(S.power_db(S.stft(A.clips(s, d), 64))), 4)


@query(f"WITH {SIG} SELECT a.media_id, k::INT AS lag, {r('sum(a.y * b.y)', 4)} AS r FROM sig a, range(8) t(k) LEFT JOIN sig b ON a.media_id = b.media_id AND b.n = a.n - k GROUP BY 1, 2")
def autocorrelation(s, d):
    return rounded(S.autocorrelation(A.signal(s, d), 8), 4)


RATE, BANDS = 22050.0, 10
MEL = f"""{SPEC}, edge AS (SELECT i, CASE WHEN mm < 15 THEN mm * 200 / 3 ELSE 1000 * exp((mm - 15) * ln(6.4::DOUBLE) / 27) END AS f FROM (SELECT i, i * (15 + ln({RATE / 2000}::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / {BANDS + 1} AS mm FROM range({BANDS + 2}) t(i))),
fb AS (SELECT a.i::INT AS band, k::INT AS k, greatest(0, least((k * {RATE / 64}::DOUBLE - a.f) / (b.f - a.f), (c.f - k * {RATE / 64}::DOUBLE) / (c.f - b.f))) * 2 / (c.f - a.f) AS w FROM edge a JOIN edge b ON b.i = a.i + 1 JOIN edge c ON c.i = a.i + 2, range(33) t(k)),
mel AS (SELECT media_id, frame_idx, band, sum(w * mag * mag) AS power FROM spec JOIN fb USING (k) GROUP BY 1, 2, 3)"""


@query(f"WITH {MEL} SELECT media_id, frame_idx, band, {r('power', 9)} AS power FROM mel")
def mel_power(s, d):
    return rounded(T.mel_power(S.stft(A.clips(s, d), 64), RATE, 64, BANDS), 9)


@query(f"WITH {SPEC}, c AS (SELECT media_id, frame_idx, (round(69 + 12 * log2(k * {RATE / 64}::DOUBLE / 440))::INT % 12)::INT AS pitch, sum(mag * mag) AS e FROM spec WHERE k > 0 GROUP BY 1, 2, 3) SELECT media_id, frame_idx, pitch, {r('coalesce(e / nullif(max(e) OVER (PARTITION BY media_id, frame_idx), 0), 0)')} AS chroma FROM c")
def chroma(s, d):
    return rounded(T.chroma(S.stft(A.clips(s, d), 64), RATE, 64))


@query(f"WITH {SPEC}, m AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY media_id, k ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS h, quantile_cont(mag, 0.5) OVER (PARTITION BY media_id, frame_idx ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS p FROM spec), o AS (SELECT *, coalesce(mag * h * h / nullif(h * h + p * p, 0), 0) AS hm, coalesce(mag * p * p / nullif(p * p + 25 * h * h, 0), 0) AS pm FROM m) SELECT media_id, frame_idx, k, {r('hm')} AS harmonic, {r('pm')} AS percussive, {r('mag - hm - pm')} AS residual FROM o")
def hpss(s, d):
    return rounded(T.harmonic_percussive(S.stft(A.clips(s, d), 64), 7))


def onsets(s, d):
    """Each event's value as the strength of an onset."""
    return A.signal(s, d).select("media_id", F.col("n").alias("frame_idx"), F.col("y").alias("onset"))


TEMPOGRAM = f"""{SIG}, w AS (SELECT a.media_id, a.n, i, b.y * (0.5 - 0.5 * cos(2 * pi() * (i + 1) / 18)) AS y FROM sig a, range(17) t(i) JOIN sig b ON b.media_id = a.media_id AND b.n = a.n - 8 + i),
dots AS (SELECT a.media_id, a.n, lag, coalesce(sum(a.y * b.y), 0) AS dot FROM (SELECT w.*, lag FROM w, range(9) t(lag)) a LEFT JOIN w b ON b.media_id = a.media_id AND b.n = a.n AND b.i = a.i + a.lag GROUP BY 1, 2, 3),
tg AS (SELECT media_id, n AS frame_idx, lag::INT AS lag, coalesce(dot / nullif(max(CASE WHEN lag = 0 THEN dot END) OVER (PARTITION BY media_id, n), 0), 0) AS r FROM dots)"""


@query(f"WITH {TEMPOGRAM} SELECT media_id, frame_idx, lag, {r('r')} AS r FROM tg")
def tempogram(s, d):
    return rounded(T.tempogram(onsets(s, d), 8))


@query(f"WITH {TEMPOGRAM}, m AS (SELECT media_id, lag, avg(r) AS r FROM tg WHERE lag > 0 GROUP BY 1, 2) SELECT media_id, {r('arg_max(240.0::DOUBLE / lag, ln(1 + 1e6 * greatest(r, 0)) - 0.5 * (log2(240.0::DOUBLE / lag) - log2(120.0::DOUBLE)) ** 2)')} AS bpm FROM m GROUP BY 1")
def tempo(s, d):
    return rounded(T.tempo(T.tempogram(onsets(s, d), 8), 4.0))


@query(f"WITH {SIG}, c AS (SELECT media_id, count(*) AS c FROM sig GROUP BY 1), o AS (SELECT media_id, t::INT AS t, floor(t * 0.75)::INT AS n FROM c, range((SELECT (max(c) * 2) FROM c)) q(t) WHERE floor(t * 0.75) < c) SELECT media_id, n, t, y FROM o JOIN sig USING (media_id, n)")
def audio_dilate(s, d):
    return T.dilate(A.signal(s, d), 0.75)


def ssm_sql(size: str) -> str:
    return f"WITH {CLIP}, z AS (SELECT media_id, frame_idx, list_transform(vec, lambda e: e::DOUBLE) AS u FROM clip), f AS (SELECT media_id, frame_idx, CASE WHEN {size} >= 1e-3 THEN list_transform(u, lambda e: e / {size}) ELSE u END AS w FROM z) SELECT a.media_id, a.frame_idx AS i, b.frame_idx AS j, {r('list_dot_product(a.w, b.w)')} AS s FROM f a JOIN f b ON a.media_id = b.media_id AND a.frame_idx <= b.frame_idx"


@query(ssm_sql("list_max(list_transform(u, lambda e: abs(e)))"))
def ssm_maxnorm(s, d):
    return rounded(S.self_similarity(S.normalised(A.clips(s, d))))


@query(ssm_sql("sqrt(list_dot_product(u, u))"))
def ssm_l2(s, d):
    return rounded(S.self_similarity(S.normalised(A.clips(s, d), "l2")))


@query(f"""WITH RECURSIVE {BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, box) AS k FROM box),
 step AS (SELECT frame_idx, k, [k] AS kept, [struct_pack(x1, y1, x2, y2)] AS held FROM o WHERE k = 1
 UNION ALL SELECT o.frame_idx, o.k, CASE WHEN free THEN list_append(kept, o.k) ELSE kept END, CASE WHEN free THEN list_append(held, struct_pack(x1, y1, x2, y2)) ELSE held END FROM (
  SELECT o.*, kept, held, len(list_filter(held, lambda q: greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1) + 1) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1) + 1) >=
   0.3 * ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1) + (o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1) - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1) + 1) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1) + 1)))) = 0 AS free
  FROM step JOIN o ON o.frame_idx = step.frame_idx AND o.k = step.k + 1) o),
 last AS (SELECT frame_idx, arg_max(kept, k) AS kept FROM step GROUP BY 1)
 SELECT o.* EXCLUDE (k) FROM o JOIN (SELECT frame_idx, unnest(kept) AS k FROM last) USING (frame_idx, k)""")
def nms(s, d):
    return S.suppressed(A.boxes(s, d))


@query(f"WITH {BOX}, p AS (SELECT a.frame_idx, a.box AS a_box, b.box AS b_box, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) AS n, (a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS u FROM box a JOIN box b ON a.frame_idx = b.frame_idx AND a.box < b.box) SELECT frame_idx, a_box, b_box, {r('n / (u - n)')} AS iou FROM p WHERE n / (u - n) >= 0.1")
def box_overlaps(s, d):
    return rounded(S.overlaps(A.boxes(s, d), 0.1))


@query(f"WITH {BOX}, p AS (SELECT frame_idx, x1 + 1 AS px, y1 + 1 AS py FROM box) SELECT b.frame_idx, b.box, count(*) AS n FROM p JOIN box b ON p.frame_idx = b.frame_idx AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY 1, 2")
def box_range_join(s, d):
    b = A.boxes(s, d)
    return S.box_join(b.select("frame_idx", (F.col("x1") + 1).alias("px"), (F.col("y1") + 1).alias("py")), b)


@query(f"WITH {BOX}, p AS (SELECT (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM box), g AS (SELECT i::INT AS i, j::INT AS j, (i + 0.5) * 60.0::DOUBLE / 6 AS gx, (j + 0.5) * 60.0::DOUBLE / 6 AS gy FROM range(6) a(i), range(6) b(j)), n AS (SELECT i, j, sqrt((gx - x) ** 2 + (gy - y) ** 2) AS d, row_number() OVER (PARTITION BY i, j ORDER BY sqrt((gx - x) ** 2 + (gy - y) ** 2)) AS k FROM g, p) SELECT i, j, {r('1 / nullif(sum(d), 0)')} AS heat FROM n WHERE k <= 32 GROUP BY 1, 2")
def heatmap_knn(s, d):
    return rounded(S.heat_grid(A.boxes(s, d).select(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), 6, 60.0, 32))


KEY = f"{PX}, kp AS (SELECT media_id, frame_idx, y AS part, arg_max(x, v * 10 - x) AS px, max(v) AS py FROM px GROUP BY 1, 2, 3)"


def keypoints(s, d):
    """One part per pixel row: where its greatest value is, and how great."""
    best = F.struct("v", (-F.col("x")).alias("x"))
    return A.pixels(s, d).groupBy("media_id", "frame_idx", F.col("y").alias("part")).agg(F.max_by("x", best).alias("px"), F.max("v").alias("py"))


@query(f"WITH {KEY} SELECT * FROM kp WHERE py > 100")
def keypoint_argmax(s, d):
    return keypoints(s, d).where("py > 100")


@query(f"WITH {KEY}, e(a, b) AS (VALUES (0, 1), (1, 2), (2, 3), (1, 5)) SELECT p.media_id, p.frame_idx, a, b, {r('sqrt((p.px - q.px) ** 2 + (p.py - q.py) ** 2)')} AS length FROM e JOIN kp p ON p.part = a JOIN kp q ON q.part = b AND p.media_id = q.media_id AND p.frame_idx = q.frame_idx")
def skeleton_join(s, d):
    return rounded(S.skeleton(keypoints(s, d), s.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 5)], "a int, b int")))


@query(f"WITH {KEY}, st AS (SELECT media_id, frame_idx, sqrt((px - lag(px) OVER w) ** 2 + (py - lag(py) OVER w) ** 2) AS s FROM kp WINDOW w AS (PARTITION BY media_id, part ORDER BY frame_idx)), f AS (SELECT media_id, frame_idx, coalesce(avg(s), 0) AS m FROM st GROUP BY 1, 2), t AS (SELECT media_id, avg(m) AS a, max(m) AS x, stddev_pop(m) AS s FROM f GROUP BY 1) SELECT media_id, {r('any_value(a)')} AS avg, {r('any_value(x)')} AS max, {r('any_value(s)')} AS std, count(*) FILTER (m > a + s) AS peaks FROM f JOIN t USING (media_id) GROUP BY 1")
def pose_movement(s, d):
    return rounded(S.movement(keypoints(s, d)))


@query(f"WITH {KEY}, v AS (SELECT media_id, part, (var_samp(px) + var_samp(py)) / 2 AS v FROM kp GROUP BY 1, 2) SELECT media_id, {r('avg(v)')} AS activity FROM v GROUP BY 1")
def part_activity(s, d):
    return rounded(S.part_variance(keypoints(s, d)))


@query(f"WITH {KEY} SELECT media_id, {r('count(*) FILTER (py <= 200) / count(*)')} AS missing FROM kp GROUP BY 1")
def missing_ratio(s, d):
    gaps = keypoints(s, d).withColumn("px", F.when(F.col("py") > 200, F.col("px")))
    return rounded(gaps.groupBy("media_id").agg((F.count_if(F.col("px").isNull()) / F.count("*")).alias("missing")))


@query(f"SELECT o_orderpriority, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total, {r('avg(o_totalprice)', 2)} AS mean, max(o_totalprice) AS most, {r('stddev_samp(o_totalprice)', 2)} AS std, count(*) FILTER (o_totalprice > 200000) AS n_active, {r('100.0 * count(*) FILTER (o_totalprice > 200000) / count(*)', 2)} AS percent_active FROM orders GROUP BY 1")
def batch_stats(s, d):
    return rounded(S.batch_stats(A.table(s, d, "orders"), "o_orderpriority", "o_totalprice", 200000.0), 2)


def grouping_sql(kind: str) -> str:
    return f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, {r('avg(o_totalprice)', 2)} AS mean FROM orders GROUP BY {kind} (o_orderpriority, o_orderstatus)"


@query(grouping_sql("ROLLUP"))
def config_rollup(s, d):
    return rounded(A.table(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 2)


@query(grouping_sql("CUBE"))
def config_cube(s, d):
    return rounded(A.table(s, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 2)


@query(f"SELECT event_type AS type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS total, {r('avg((props->>$$$.k$$)::INT)')} AS mean FROM events GROUP BY 1")
def coded_frame_groups(s, d):
    return rounded(A.coded_frames(s, d).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.avg("size").alias("mean")))


@query("SELECT event_id, event_type AS codec_type, user_id::VARCHAR AS v FROM events")
def metadata_kv(s, d):
    """Probe text of key=value lines to maps, one stream a row."""
    from ..sources.media import metadata

    lines = F.concat(F.lit("codec_type="), "event_type", F.lit("\nuser="), F.col("user_id").cast("string"))
    found = metadata(A.table(s, d, "events").select(F.col("event_id").alias("media_id"), lines.alias("text")))
    return found.select(F.col("media_id").alias("event_id"), "codec_type", F.element_at("kv", "user").alias("v"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), z AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM z GROUP BY user_id, k")
def session_activity(s, d):
    return streams.sessions(A.table(s, d, "events")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(s, d):
    return A.table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT (date_trunc('hour', ts) - INTERVAL (h) HOUR) AS start, count(*) AS n FROM events, range(2) t(h) GROUP BY 1")
def sliding(s, d):
    return A.table(s, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(f"SELECT o_orderkey, (ceil(o_custkey / 7.0) * 7)::BIGINT AS up, least(greatest(o_totalprice, 1000), 50000) AS clamped, {r('(o_totalprice - 1000) * (1.0 - -1.0) / (50000 - 1000) + -1.0')} AS scaled, round_even(o_orderkey / 29.97 * 1000, 0)::BIGINT AS ms, {r('CASE WHEN o_totalprice < 1000 THEN o_totalprice * 3 / 200 ELSE 15 + 27 * ln(o_totalprice / 1000) / ln(6.4) END')} AS mel FROM orders")
def scalar_functions(s, d):
    t, p = A.table(s, d, "orders"), F.col("o_totalprice")
    return rounded(t.select("o_orderkey", X.roundup(F.col("o_custkey"), 7).alias("up"), X.clamp(p, 1000.0, 50000.0).alias("clamped"), X.scale_num(p, 1000, 50000, -1.0, 1.0).alias("scaled"), X.frame2ms(F.col("o_orderkey"), 29.97).alias("ms"), X.hz_to_mel(p).alias("mel")))


@query(f"WITH {PX}, n AS (SELECT media_id, max(frame_idx) + 1 AS n FROM px GROUP BY 1), starts AS (SELECT media_id, coalesce(sum(n) OVER (ORDER BY media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n) SELECT 0 AS media_id, (frame_idx + ahead)::INT AS frame_idx, y, x, v FROM px JOIN starts USING (media_id)")
def concat_all_clips(s, d):
    """Every clip joined end to end as one, by frame offsets that are a running sum over the clips' lengths."""
    px = A.pixels(s, d)
    ends = px.groupBy("media_id").agg((F.max("frame_idx") + 1).alias("n"))
    before = Window.orderBy("media_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("media_id", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("at"))
    return px.join(starts, "media_id").select(F.lit(0).alias("media_id"), (F.col("frame_idx") + F.col("at")).alias("frame_idx"), "y", "x", "v")


@query("SELECT c_nationkey AS k, 'c' AS side FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY 1 UNION ALL SELECT DISTINCT s_nationkey, 's' FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)")
def set_ops_all(s, d):
    """With and without a partner, then a bag union, over every key."""
    c = A.table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    p = A.table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.join(p, "k", "left_anti").distinct().withColumn("side", F.lit("c")).unionByName(p.join(c, "k", "left_semi").distinct().withColumn("side", F.lit("s")))


FEATURES = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
PAIRS = [(a, b) for k, a in enumerate(FEATURES) for b in list(FEATURES)[k + 1 :]]
STATS = {"mean": "avg", "std": "stddev_samp", "least": "min", "most": "max"}


@query("SELECT " + ", ".join([f"{r(f'corr({FEATURES[a]}, {FEATURES[b]})')} AS {a}{b}" for a, b in PAIRS] + [f"{r(f'{f}({c})')} AS {k}_{n}" for k, c in FEATURES.items() for n, f in STATS.items()]) + " FROM lineitem")
def corr_columns(s, d):
    """The correlation of every pair of columns, and each column's statistics."""
    pairs = [F.corr(FEATURES[a], FEATURES[b]).alias(f"{a}{b}") for a, b in PAIRS]
    return rounded(A.table(s, d, "lineitem").agg(*pairs, *[F.expr(f"{f}({c})").alias(f"{k}_{n}") for k, c in FEATURES.items() for n, f in STATS.items()]))


# The same jobs under their earlier names, which once covered two clips, some keys and some pairs.
for _name, _whole in (("concat_clips", "concat_all_clips"), ("set_ops", "set_ops_all"), ("corr_matrix", "corr_columns")):
    QUERIES[_name], SQL[_name] = QUERIES[_whole], SQL[_whole]

from . import composites, flows, regions, sampled  # noqa: E402, F401  (register more queries)
