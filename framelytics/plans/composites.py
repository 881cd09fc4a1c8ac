"""Queries in colour, of whole motion chains, of features and of facts, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import colour as C
from ..operators import features as V
from ..operators import frames as P
from ..operators import series as S
from ..operators import spectra as T
from ..sources import adapters as A
from ..sources import probe
from .registry import CLIP, FLOW, FPS, GRAM, MOT, PX, RATE, SIG, SPEC, TEMPOGRAM, H, W, moved, near, onsets, query, r, rounded

CPX = f"{CLIP}, cpx AS (SELECT media_id, frame_idx, (i // 8)::INT AS y, (i % 8)::INT AS x, c::INT AS c, floor(least(greatest((vec[(i + 21 * c) % 64 + 1]::DOUBLE + 0.5) * 255, 0), 255))::INT AS v FROM clip, range(64) t(i), range(3) u(c))"
GRAY = f"{CPX}, gray AS (SELECT media_id, frame_idx, y, x, round_even(0.114::DOUBLE * max(v) FILTER (c = 0) + 0.587::DOUBLE * max(v) FILTER (c = 1) + 0.299::DOUBLE * max(v) FILTER (c = 2), 0)::INT AS v FROM cpx GROUP BY 1, 2, 3, 4)"


@query(f"WITH {GRAY} SELECT * FROM gray")
def grayscale(s, d):
    return C.grayscale(A.colours(s, d))


@query(f"WITH {GRAY}, l AS (SELECT media_id, frame_idx, x, y, abs(v - lag(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx)) AS d FROM gray), m AS (SELECT media_id, frame_idx - 1 AS frame_idx, sum(d)::BIGINT AS q, sum(x * d)::DOUBLE AS sx, sum(y * d)::DOUBLE AS sy FROM l WHERE d IS NOT NULL GROUP BY 1, 2) SELECT media_id, frame_idx, round_even(frame_idx / 25.0 * 1000, 0)::BIGINT AS \"Time\", q AS \"Qom\", {r('CASE WHEN q > 0 THEN sx / q ELSE 0 END / 8')} AS \"ComX\", {r('(8 - CASE WHEN q > 0 THEN sy / q ELSE 0 END) / 8')} AS \"ComY\" FROM m")
def motion_of_colour(s, d):
    """Colour frames to gray, their difference, quantity and centroid of motion in one plan."""
    return rounded(P.motion(P.difference(C.grayscale(A.colours(s, d))), W, H, FPS))


@query(f"WITH {CPX}, l AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY media_id, c, y, x ORDER BY frame_idx)) AS d FROM cpx) SELECT media_id, c, frame_idx - 1 AS frame_idx, y, x, CASE WHEN d > 0.05 * 255 THEN d ELSE 0 END AS v FROM l WHERE d IS NOT NULL")
def motion_video_colour(s, d):
    return C.from_channels(P.threshold(P.difference(C.per_channel(A.colours(s, d))), 0.05))


@query(f"WITH {CPX} SELECT media_id, frame_idx, x AS pos, c, {r('avg(v)')} AS v FROM cpx GROUP BY 1, 2, 3, 4")
def videogram_colour_x(s, d):
    return rounded(C.videogram(A.colours(s, d), "x"))


@query(f"WITH {CPX} SELECT media_id, frame_idx, y AS pos, c, {r('avg(v)')} AS v FROM cpx GROUP BY 1, 2, 3, 4")
def videogram_colour_y(s, d):
    return rounded(C.videogram(A.colours(s, d), "y"))


@query(f"WITH {CPX} SELECT media_id, (frame_idx // 16)::INT AS row, frame_idx % 16 AS col, c, floor(avg(v))::INT AS v FROM cpx GROUP BY media_id, frame_idx, c")
def pixelarray_colour(s, d):
    return C.pixel_array(A.colours(s, d), 16)


@query(f"WITH {CPX} SELECT media_id, y, x, c, {r('avg(v)')} AS average, max(v) AS lighten, min(v) AS darken FROM cpx GROUP BY 1, 2, 3, 4")
def blend_colour(s, d):
    return rounded(C.blend(A.colours(s, d)))


CGRAM = f"{CPX}, cg AS (SELECT media_id, frame_idx, x AS pos, c, floor(avg(v))::INT AS v FROM cpx GROUP BY 1, 2, 3, 4)"


@query(f"WITH {CGRAM}, m AS (SELECT media_id, frame_idx, pos, max(v) AS most FROM cg GROUP BY 1, 2, 3), n AS (SELECT media_id, most, count(*) AS n FROM m GROUP BY 1, 2), f AS (SELECT media_id, most, sum(n) OVER w AS cdf, first(n) OVER w AS low, sum(n) OVER (PARTITION BY media_id) AS n FROM n WINDOW w AS (PARTITION BY media_id ORDER BY most)), t AS (SELECT media_id, most, CASE WHEN n > low THEN round(255 * (cdf - low)::DOUBLE / (n - low)) ELSE most END::INT AS z FROM f) SELECT media_id, frame_idx, pos, c, (CASE WHEN most > 0 THEN round_even(v * z::DOUBLE / most, 0) ELSE z END)::INT AS v FROM cg JOIN m USING (media_id, frame_idx, pos) JOIN t USING (media_id, most)")
def equalize_colour(s, d):
    """A colour gram with its value equalised; hue and saturation stay."""
    gram = C.videogram(A.colours(s, d), "x").withColumn("v", F.floor("v").cast("int"))
    return C.equalise_value(gram)


@query(f"""WITH {CGRAM}, px3 AS (SELECT media_id, frame_idx, pos, max(v) FILTER (c = 0) AS b, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS r FROM cg GROUP BY 1, 2, 3), d AS (SELECT *, greatest(b, g, r) AS value, greatest(b, g, r) - least(b, g, r) AS away FROM px3),
turn AS (SELECT *, floor((away * CASE WHEN value > 0 THEN round_even(255 * 4096::DOUBLE / value, 0) ELSE 0 END + 2048) / 4096) AS s, floor((CASE WHEN value = r THEN g - b WHEN value = g THEN b - r + 2 * away ELSE r - g + 4 * away END * CASE WHEN away > 0 THEN round_even(30 * 4096::DOUBLE / away, 0) ELSE 0 END + 2048) / 4096) AS t FROM d),
hsv AS (SELECT media_id, frame_idx, pos, s / 255 AS s, value, (CASE WHEN t < 0 THEN t + 180 ELSE t END) / 30 AS h FROM turn),
n AS (SELECT media_id, value, count(*) AS n FROM hsv GROUP BY 1, 2), f AS (SELECT media_id, value, sum(n) OVER w AS cdf, first(n) OVER w AS low, sum(n) OVER (PARTITION BY media_id) AS n FROM n WINDOW w AS (PARTITION BY media_id ORDER BY value)),
t AS (SELECT media_id, value, CASE WHEN n > low THEN round_even(255 * (cdf - low)::DOUBLE / (n - low), 0) ELSE value END AS z FROM f),
parts AS (SELECT media_id, frame_idx, pos, floor(h)::INT % 6 AS k, round_even(z, 0) AS full_, round_even(z * (1 - s), 0) AS low, round_even(z * (1 - s * (h - floor(h))), 0) AS falling, round_even(z * (1 - s * (1 - h + floor(h))), 0) AS rising FROM hsv JOIN t USING (media_id, value))
SELECT media_id, frame_idx, pos, c::INT AS c, (CASE c WHEN 0 THEN [low, low, rising, full_, full_, falling] WHEN 1 THEN [rising, full_, full_, falling, low, low] ELSE [full_, falling, low, low, rising, full_] END)[k + 1]::INT AS v FROM parts, range(3) u(c)""")
def equalize_hsv(s, d):
    """A colour gram with its value equalised by way of 8-bit hue, saturation and value."""
    gram = C.videogram(A.colours(s, d), "x").withColumn("v", F.floor("v").cast("int"))
    return C.equalise_hsv(gram)


@query(f"WITH {FLOW}, m AS (SELECT media_id, frame_idx, y, x, (CASE WHEN atan2(fy, fx) < 0 THEN atan2(fy, fx) + 2 * pi() ELSE atan2(fy, fx) END) * 90 / pi() AS hue, sqrt(fx * fx + fy * fy) AS mag FROM flow) SELECT media_id, frame_idx, y, x, {r('hue')} AS hue, {r('coalesce((mag - min(mag) OVER f) * 255 / nullif(max(mag) OVER f - min(mag) OVER f, 0), 0)')} AS value FROM m WINDOW f AS (PARTITION BY media_id, frame_idx)")
def flow_hsv(s, d):
    return rounded(C.flow_colours(P.gradient_flow(A.pixels(s, d))))


EMPTY = "CASE WHEN frame_idx % 3 = 0 THEN v ELSE 0 END"


@query(f"WITH {MOT}, e AS (SELECT media_id, frame_idx, y, x, {EMPTY} AS v FROM mot), q AS (SELECT media_id, frame_idx, sum(v) AS q FROM e GROUP BY 1, 2), z AS (SELECT media_id, frame_idx, max(CASE WHEN q > 0 OR frame_idx = 0 THEN frame_idx END) OVER (PARTITION BY media_id ORDER BY frame_idx) AS source FROM q) SELECT media_id, z.frame_idx, y, x, v FROM z JOIN e USING (media_id) WHERE e.frame_idx = source")
def flow_repeat(s, d):
    """Two of three frames are empty and show the last that isn't."""
    return C.repeat_empty(moved(s, d).withColumn("v", F.expr(EMPTY)))


@query(f"WITH {PX}, bg AS (SELECT media_id, y, x, floor(avg(v))::INT AS b FROM px GROUP BY 1, 2, 3), o AS (SELECT px.*, CASE WHEN abs(v - b) > 0.1 * 255 THEN abs(v - b) ELSE 0 END / 255::DOUBLE AS over FROM px JOIN bg USING (media_id, y, x)), m AS (SELECT *, least(1, greatest(0, (over - 0.24) / 0.1::DOUBLE)) AS mask FROM o) SELECT media_id, frame_idx, y, x, round_even(255 * (1 - mask) + v * mask, 0)::INT AS v FROM m")
def bg_subtract_curve(s, d):
    return C.subtract_background(A.pixels(s, d), 0.1, 0.2)


@query(f"WITH {PX} SELECT media_id, frame_idx, y, x, floor(least(greatest(((v / 255::DOUBLE - 0.5) * 1.26 + 0.5 + (0.04::DOUBLE * 20 / 100 + 10 / 100::DOUBLE)) * 255, 0), 255))::INT AS v FROM px")
def contrast_equaliser(s, d):
    return A.pixels(s, d).withColumn("v", C.equaliser(F.col("v"), 20, 10))


COLOURS = [(60, 60, 60), (0, 120, 255), (255, 200, 0), (255, 0, 40)]


@query(f"WITH {PX}, g AS (SELECT * FROM (VALUES (0, 60, 60, 60), (1, 0, 120, 255), (2, 255, 200, 0), (3, 255, 0, 40)) t(k, r, g, b)), i AS (SELECT *, v * 3 / 255::DOUBLE AS place, floor(v * 3 / 255::DOUBLE)::INT AS low FROM px) SELECT media_id, frame_idx, y, x, " + ", ".join(f"floor((1 - (place - low)) * a.{n} + (place - low) * coalesce(z.{n}, 0))::INT AS {n}" for n in "rgb") + " FROM i JOIN g a ON a.k = low LEFT JOIN g z ON z.k = low + 1")
def colour_palette(s, d):
    """Gray frames in the colours of a palette; the palette has 256 rows."""
    return A.pixels(s, d).join(F.broadcast(C.palette(s, COLOURS).withColumnRenamed("i", "v")), "v").select("media_id", "frame_idx", "y", "x", "r", "g", "b")


# Chains

GAUSS = ", ".join(f"({j - 5}, {w!r}::DOUBLE)" for j, w in enumerate(P.gaussian_weights(11)))
ADAPT = f"""{PX}, gw(j, w) AS (VALUES {GAUSS}), gx AS (SELECT a.media_id, a.frame_idx, a.y, a.x, sum(w * b.v) AS m FROM px a, gw JOIN px b ON b.media_id = a.media_id AND b.frame_idx = a.frame_idx AND b.y = a.y AND b.x = least(greatest(a.x + j, 0), 7) GROUP BY 1, 2, 3, 4),
 gy AS (SELECT a.media_id, a.frame_idx, a.y, a.x, sum(w * b.m) AS m FROM gx a, gw JOIN gx b ON b.media_id = a.media_id AND b.frame_idx = a.frame_idx AND b.x = a.x AND b.y = least(greatest(a.y + j, 0), 7) GROUP BY 1, 2, 3, 4),
 ad AS (SELECT media_id, frame_idx, y, x, CASE WHEN v - round_even(m, 0) > -2 THEN 255 ELSE 0 END AS v FROM px JOIN gy USING (media_id, frame_idx, y, x))"""


@query(f"WITH {ADAPT} SELECT * FROM ad")
def adaptive_gaussian(s, d):
    return P.adaptive_gaussian(A.pixels(s, d), 11, 2)


ADFLOW = ADAPT + FLOW.removeprefix(PX).replace("FROM px)", "FROM ad)")
EDGES = "e AS (SELECT list(-pi() + k * 2 * pi() / 99 ORDER BY k) AS es FROM range(99) t(k))"
DIRS = f"{ADFLOW}, ang AS (SELECT media_id, frame_idx, atan2(fy, fx) AS a, sqrt(fx*fx + fy*fy) AS l FROM flow WHERE fx <> 0 OR fy <> 0), {EDGES}, dirs AS (SELECT media_id, frame_idx, len(list_filter(es, lambda z: z <= a))::INT AS bin, sum(l) AS mag FROM ang, e GROUP BY 1, 2, 3)"


def adaptive_directogram(s, d, bins=100):
    return P.directogram(P.gradient_flow(P.adaptive_gaussian(A.pixels(s, d), 11, 2)), bins)


@query(f"WITH {DIRS} SELECT media_id, frame_idx, bin, {r('mag')} AS mag FROM dirs")
def directogram_adaptive(s, d):
    """Threshold, flow and directogram in one plan."""
    return rounded(adaptive_directogram(s, d))


#: Of 8 bins, as 100 of them are nearly empty on frames of 64 pixels.
COARSE = DIRS.replace("2 * pi() / 99", "2 * pi() / 7").replace("range(99)", "range(7)")
ENVELOPE = f"""{COARSE}, dense AS (SELECT l.media_id, f::INT AS frame_idx, b::INT AS bin, coalesce(mag, 0) AS mag FROM (SELECT media_id, max(frame_idx) AS last FROM dirs GROUP BY 1) l, range(1000000) t(f), range(8) u(b) LEFT JOIN dirs ON dirs.media_id = l.media_id AND dirs.frame_idx = f AND dirs.bin = b WHERE f <= last),
 med AS (SELECT a.media_id, a.frame_idx, a.bin, list_sort(list_concat(list(z.mag), list_transform(range(25 - count(*)), lambda q: 0.0::DOUBLE)))[13] AS m FROM dense a JOIN dense z ON z.media_id = a.media_id AND z.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2 AND z.bin BETWEEN a.bin - 2 AND a.bin + 2 GROUP BY 1, 2, 3),
 rise AS (SELECT media_id, frame_idx, coalesce(greatest(m - lag(m) OVER (PARTITION BY media_id, bin ORDER BY frame_idx), 0), 0) AS d FROM med),
 env AS (SELECT media_id, frame_idx AS n, round(sum(d), 9) AS d FROM rise GROUP BY 1, 2), cut AS (SELECT media_id, n, CASE WHEN d > quantile_cont(d, 0.98) OVER (PARTITION BY media_id) THEN 0 ELSE d END AS d FROM env),
 imp AS (SELECT media_id, n, coalesce(d / nullif(max(d) OVER (PARTITION BY media_id), 0), 0) AS y FROM cut)"""
ENVELOPE = ENVELOPE.replace("range(1000000) t(f)", "(SELECT unnest(range((SELECT max(frame_idx) + 1 FROM dirs))) AS f) t")


def envelope(s, d):
    return S.impact_envelope(adaptive_directogram(s, d, 8), 8)


@query(f"WITH {ENVELOPE} SELECT media_id, n, {r('y')} AS y FROM imp")
def impact_envelope(s, d):
    return rounded(envelope(s, d))


@query(f"WITH {ENVELOPE}, z AS (SELECT media_id, n, round(y, 9) AS y FROM imp), w AS (SELECT *, (lag(y) OVER w + lead(y) OVER w) / 2 AS m, greatest(lag(y) OVER w, lead(y) OVER w) AS near, max(y) OVER (PARTITION BY media_id) AS top, count(*) OVER (PARTITION BY media_id) AS len FROM z WINDOW w AS (PARTITION BY media_id ORDER BY n)) SELECT media_id, n, {r('y')} AS y FROM w WHERE n >= 5 AND n < len - 5 AND y > near AND y - m > 0.1 * top")
def impacts_of_motion(s, d):
    """Directogram, impact envelope and impacts in one plan."""
    return rounded(S.impacts(envelope(s, d).withColumn("y", F.round("y", 9)), 1, 1))


def blurred_motion(s, d):
    return P.invert(P.median(P.threshold(P.difference(P.box_blur(A.pixels(s, d), 10)), 0.02, True), 3))


BLUR = "SELECT media_id, frame_idx, y + dy AS y, x + dx AS x, (sum(v) // count(*))::INT AS v FROM px, (SELECT unnest(range(-4, 6))::INT AS dy), (SELECT unnest(range(-4, 6))::INT AS dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4"


@query(f"WITH {PX}, bl AS ({BLUR}), l AS (SELECT media_id, frame_idx, y, x, abs(v - lag(v) OVER (PARTITION BY media_id, y, x ORDER BY frame_idx)) AS d FROM bl), h AS (SELECT media_id, frame_idx - 1 AS frame_idx, y, x, CASE WHEN d > 0.02 * 255 THEN 255 ELSE 0 END AS v FROM l WHERE d IS NOT NULL), m AS ({near(3, 'list_sort(list_concat(list(v), list_resize([]::INT[], 9 - count(*), 0)))[5]', 'h')}) SELECT media_id, frame_idx, y, x, 255 - v AS v FROM m")
def filter_chain(s, d):
    """Blur, difference, binary threshold, median and inversion, in this order."""
    return blurred_motion(s, d)


@query(f"WITH {GRAM}, s AS (SELECT *, floor(avg(v) OVER (PARTITION BY media_id, pos ORDER BY frame_idx ROWS BETWEEN 64 PRECEDING AND 64 FOLLOWING))::INT AS m FROM gram), e AS (SELECT media_id, frame_idx, pos, CASE WHEN abs(m - v) < 20 THEN m ELSE v END AS v FROM s), x AS (SELECT media_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1), u AS (SELECT media_id, frame_idx, pos, CASE WHEN hi > lo THEN floor((v - lo) * 255.0 / (hi - lo)) ELSE 0 END::INT AS v FROM e JOIN x USING (media_id)), c AS (SELECT media_id, v, count(*) AS n FROM u GROUP BY 1, 2), f AS (SELECT media_id, v, sum(n) OVER w AS cdf, first(n) OVER w AS low, sum(n) OVER (PARTITION BY media_id) AS n FROM c WINDOW w AS (PARTITION BY media_id ORDER BY v)) SELECT media_id, frame_idx, pos, CASE WHEN n > low THEN round(255 * (cdf - low)::DOUBLE / (n - low)) ELSE v END::INT AS v FROM u JOIN f USING (media_id, v)")
def motiongrams_full(s, d):
    """Motion chain, gram, denoising over 129 frames, stretching and equalising in one plan."""
    gram = P.motiongram(moved(s, d), "x").select("media_id", "frame_idx", F.lit(0).alias("y"), F.col("pos").alias("x"), "v")
    even = P.denoise(gram, 64, 20).select("media_id", "frame_idx", F.col("x").alias("pos"), "v")
    return P.equalise(P.gram_minmax(even))


QUART = "q AS (SELECT media_id, n, y / max(y) OVER (PARTITION BY media_id) AS q FROM s WHERE n >= 1), p AS (SELECT media_id, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.5) AS q2, quantile_cont(q, 0.75) AS q3, arg_min(q, n) AS f, arg_max(q, n) AS l FROM q GROUP BY 1)"


@query(f"WITH {MOT}, s AS (SELECT media_id, frame_idx AS n, sum(v)::DOUBLE AS y FROM mot GROUP BY 1, 2), {QUART} SELECT media_id, {r('q1')} AS q1, {r('q2')} AS q2, {r('q3')} AS q3, {r('least(greatest(q1 - 1.5 * (q3 - q1), f), q1)')} AS lower, {r('least(greatest(q3 + 1.5 * (q3 - q1), q3), l)')} AS upper FROM p")
def motion_quartiles(s, d):
    """What a plot of the quantity of motion shows."""
    m = P.motion(moved(s, d), W, H, FPS)
    return rounded(S.quartiles(m.select("media_id", F.col("frame_idx").alias("n"), F.col("Qom").cast("double").alias("y"))))


@query(f"WITH {PX}, t AS (SELECT media_id, (frame_idx - 5) // 2 AS frame_idx, y, x, floor(least(greatest(v * (1.27::DOUBLE * 20 / 127 + 1) - 1.27::DOUBLE * 20, 0), 255))::INT AS v FROM px WHERE frame_idx >= 5 AND frame_idx < 45 AND (frame_idx - 5) % 2 = 0) SELECT media_id, frame_idx::INT AS frame_idx, x - 1 AS y, (7 - y) - 2 AS x, v FROM t WHERE x BETWEEN 1 AND 4 AND 7 - y BETWEEN 2 AND 5")
def preprocess_chain(s, d):
    """Trim, skip, rotate, contrast, crop: in the order in which a clip is opened."""
    px = P.skip(P.trim(A.pixels(s, d), 0.2, 1.8, FPS), 1)
    return P.crop(P.contrast(P.rotate90(px, H), 20, 0), 4, 4, 2, 1)


ROT = "(SELECT y::INT AS y, x::INT AS x, floor((x - 3.5::DOUBLE) * cos(0.3::DOUBLE) + (y - 3.5::DOUBLE) * sin(0.3::DOUBLE) + 4 + 1e-9)::INT AS sx, floor((y - 3.5::DOUBLE) * cos(0.3::DOUBLE) - (x - 3.5::DOUBLE) * sin(0.3::DOUBLE) + 4 + 1e-9)::INT AS sy FROM range(8) t(y), range(8) u(x))"


@query(f"WITH {PX}, f AS (SELECT DISTINCT media_id, frame_idx FROM px) SELECT f.media_id, f.frame_idx, o.y, o.x, coalesce(px.v, 0) AS v FROM f, {ROT} o LEFT JOIN px ON px.media_id = f.media_id AND px.frame_idx = f.frame_idx AND px.y = sy AND px.x = sx")
def rotate_angle(s, d):
    return P.rotate(A.pixels(s, d), 0.3, W, H)


@query(f"WITH {PX}, k AS (SELECT DISTINCT media_id, frame_idx FROM px WHERE frame_idx % 12 = 0), n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY frame_idx) - 1)::INT AS k FROM k) SELECT media_id, k AS frame_idx, y, x, v FROM px JOIN n USING (media_id, frame_idx)")
def keyframes(s, d):
    """Every twelfth frame is coded whole."""
    px = A.pixels(s, d)
    coded = px.select("media_id", "frame_idx").distinct().withColumn("type", F.when(F.col("frame_idx") % 12 == 0, "I").otherwise("P"))
    return P.keyframes(px, coded)


@query(f"WITH {PX} SELECT * FROM px WHERE frame_idx = 13")
def frame_pick(s, d):
    return P.frame_at(A.pixels(s, d), time=0.52, fps=FPS)


@query(f"WITH {PX} SELECT * FROM px WHERE frame_idx = 0")
def first_frame(s, d):
    return P.frame_at(A.pixels(s, d), 0)


PYRAMID = f"""WITH RECURSIVE {PX}, n AS (SELECT media_id, max(frame_idx) + 1 AS n FROM px GROUP BY 1), tree AS (SELECT 0 AS level, media_id, n, frame_idx::BIGINT AS k, y, x, v FROM px JOIN n USING (media_id)
 UNION ALL SELECT level + 1, media_id, n // 2, k // 2, y, x, max(v) - min(v) FROM tree WHERE n > 1 AND k // 2 < n // 2 GROUP BY level, media_id, n, k // 2, y, x) SELECT media_id, y, x, v FROM tree WHERE n = 1"""


@query(PYRAMID)
def blend_pyramid(s, d):
    """Frames by twos to their difference, again and again until one is left; a last odd one falls out."""
    return P.blend_pyramid(A.pixels(s, d), "difference")


@query(f"WITH {FLOW} SELECT media_id, frame_idx, {r('sum(fx) / (count(*) / 4.0::DOUBLE * 0.04)')} AS vx, {r('sum(fy) / (count(*) / 4.0::DOUBLE * 0.04) / ((4 / tan(0.5::DOUBLE)) / 3)')} AS vy_metres FROM flow GROUP BY 1, 2")
def flow_velocity_metres(s, d):
    """Every second pixel of each axis at 25 frames a second; metres three metres away under an angle of view of 1."""
    v = P.flow_velocity(P.gradient_flow(A.pixels(s, d)), 0.04, 2)
    return rounded(v.select("media_id", "frame_idx", "vx", X.metres(F.col("vy"), 8, 1.0, 3.0).alias("vy_metres")))


# Features

BASE = f"{RATE / 64}::DOUBLE"


@query(f"WITH {SPEC}, w AS (SELECT *, k * {BASE} AS hz FROM spec), c AS (SELECT media_id, frame_idx, sum(hz * mag) / sum(mag) AS c, sum(mag) AS t, exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)) AS flat FROM w GROUP BY 1, 2), u AS (SELECT *, sum(mag) OVER (PARTITION BY media_id, frame_idx ORDER BY k) AS run FROM w), rms AS (SELECT media_id, frame_idx, sqrt(list_avg(list_transform(vec, lambda e: e::DOUBLE * e::DOUBLE))) AS rms FROM clip) SELECT media_id, frame_idx, {r('any_value(c)')} AS centroid, {r('sqrt(sum(mag / t * (hz - c) ** 2))')} AS bandwidth, {r('any_value(flat)')} AS flatness, {r('min(hz) FILTER (run >= 0.99 * t)')} AS rolloff, {r('min(hz) FILTER (run >= 0.01 * t)')} AS rolloff_min, {r('any_value(rms)')} AS rms FROM u JOIN c USING (media_id, frame_idx) JOIN rms USING (media_id, frame_idx) GROUP BY 1, 2")
def audio_descriptors(s, d):
    waves = A.clips(s, d)
    return rounded(V.descriptors(S.stft(waves, 64), waves, RATE, 64))


@query(f"WITH {SPEC}, c AS (SELECT media_id, frame_idx, sum(k * {BASE} * mag) / sum(mag) AS hz FROM spec GROUP BY 1, 2), p AS (SELECT media_id, frame_idx, list_min(v) AS lo, list_max(v) AS hi, list_position(v, list_min(v)) AS a, list_position(v, list_max(v)) AS z FROM (SELECT media_id, frame_idx, list_transform(vec, lambda e: e::DOUBLE) AS v FROM clip)), m AS (SELECT *, (log10(least(greatest(coalesce(hz, 500.0), 500.0), 11025.0)) - log10(500.0)) / (log10(11025.0) - log10(500.0)) AS place FROM p JOIN c USING (media_id, frame_idx)) SELECT media_id, frame_idx, {r('CASE WHEN a <= z THEN lo ELSE hi END')} AS first, {r('CASE WHEN a <= z THEN hi ELSE lo END')} AS second, {r('place')} AS centroid, floor(place * 255)::INT AS colour FROM m")
def waveform_colours(s, d):
    waves = A.clips(s, d)
    return rounded(V.coloured_waveform(S.stft(waves, 64), waves, RATE, 64, 500.0, 11025.0))


@query(f"WITH {SIG}, l AS (SELECT media_id, max(n) AS last FROM sig GROUP BY 1), b AS (SELECT media_id, b::INT AS block FROM l, range((SELECT max(last) // 10 + 1 FROM l)) t(b) WHERE b * 10 <= last) SELECT b.media_id, block, {r('sum(coalesce(y, 0) * (i + 1))')} AS weighed, count(*) AS n FROM b, range(16) t(i) LEFT JOIN sig ON sig.media_id = b.media_id AND sig.n = block * 10 - 8 + i GROUP BY 1, 2")
def sample_blocks(s, d):
    """Zero-padded blocks, shown by a weighed sum of each."""
    blocks = V.padded_blocks(A.signal(s, d).select("media_id", "n", "y"), 16, 10)
    weighed = F.aggregate(F.transform("vec", lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(blocks.select("media_id", "block", weighed.alias("weighed"), F.size("vec").cast("long").alias("n")))


NORMS = {1: "list_sum(list_transform(u, lambda e: abs(e)))", 2: "sqrt(list_dot_product(u, u))", math.inf: "list_max(list_transform(u, lambda e: abs(e)))", -math.inf: "list_min(list_transform(u, lambda e: abs(e)))"}


def similar(source: str, rows: str, norm: float = math.inf, smooth: bool = False) -> str:
    """SQL of the self-similarity of rows (media_id, frame_idx, k, v)."""
    window = "RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING"
    steps = f"rows AS ({rows})"
    steps += f", even AS (SELECT media_id, (frame_idx // 10)::INT AS frame_idx, k, v FROM (SELECT media_id, frame_idx, k, sum(v) OVER (PARTITION BY media_id, k ORDER BY frame_idx {window}) / 41 AS v FROM rows) WHERE frame_idx % 10 = 0)" if smooth else ", even AS (SELECT * FROM rows)"
    return f"WITH {source}, {steps}, z AS (SELECT media_id, frame_idx, list(v::DOUBLE ORDER BY k) AS u FROM even GROUP BY 1, 2), f AS (SELECT media_id, frame_idx, CASE WHEN {NORMS[norm]} >= 1e-3 THEN list_transform(u, lambda e: e / {NORMS[norm]}) ELSE u END AS w FROM z) SELECT a.media_id, a.frame_idx AS i, b.frame_idx AS j, {r('list_dot_product(a.w, b.w)')} AS s FROM f a JOIN f b ON a.media_id = b.media_id AND a.frame_idx <= b.frame_idx"


@query(similar(SPEC, "SELECT media_id, frame_idx, k, mag AS v FROM spec", smooth=True))
def ssm_spectrogram(s, d):
    return rounded(V.similarity(S.stft(A.clips(s, d), 64), "k", "mag", smooth=True))


CHROMA = f"{SPEC}, ce AS (SELECT media_id, frame_idx, (round(69 + 12 * log2(k * {BASE} / 440))::INT % 12)::INT AS k, sum(mag * mag) AS e FROM spec WHERE k > 0 GROUP BY 1, 2, 3), ch AS (SELECT media_id, frame_idx, k, coalesce(e / nullif(max(e) OVER (PARTITION BY media_id, frame_idx), 0), 0) AS v FROM ce)"


@query(similar(CHROMA, "SELECT * FROM ch", smooth=True))
def ssm_chroma(s, d):
    return rounded(V.similarity(T.chroma(S.stft(A.clips(s, d), 64), RATE, 64), "pitch", "chroma", smooth=True))


@query(similar(TEMPOGRAM, "SELECT media_id, frame_idx, lag AS k, r AS v FROM tg", smooth=True))
def ssm_tempogram(s, d):
    return rounded(V.similarity(T.tempogram(onsets(s, d), 8), "lag", "r", smooth=True))


@query(similar(GRAM, "SELECT media_id, frame_idx, pos AS k, v FROM gram"))
def ssm_motiongram(s, d):
    return rounded(V.similarity(P.motiongram(moved(s, d), "x"), "pos", "v"))


@query(similar(GRAM, "SELECT media_id, pos AS frame_idx, frame_idx AS k, v FROM gram"))
def ssm_motiongram_space(s, d):
    """Places compared over time, as a gram of columns is."""
    return rounded(V.similarity(P.motiongram(moved(s, d), "x"), "pos", "v", axis="space"))


VGRAM = f"{PX}, vg AS (SELECT media_id, frame_idx, x AS k, avg(v) AS v FROM px GROUP BY 1, 2, 3)"


def similarity_by(norm: float):
    return lambda s, d: rounded(V.similarity(P.videogram(A.pixels(s, d), "x"), "pos", "v", norm))


for _name, _norm in (("ssm_videogram_sum", 1), ("ssm_videogram_length", 2), ("ssm_videogram_most", math.inf), ("ssm_videogram_least", -math.inf)):
    _query = similarity_by(_norm)
    _query.__name__ = _name
    query(similar(VGRAM, "SELECT * FROM vg", _norm))(_query)


PARTS = {0: "Nose", 1: "Neck", 2: "Right Shoulder", 3: "Right Elbow", 4: "Right Wrist", 5: "Left Shoulder", 6: "Left Elbow", 7: "Left Wrist"}
KEY = f"{PX}, kp AS (SELECT media_id, frame_idx, y AS part, arg_max(x, v * 10 - x) AS px, max(v) AS py FROM px GROUP BY 1, 2, 3)"


def _keypoints(s, d):
    from .registry import keypoints

    return keypoints(s, d)


@query(f"WITH {KEY} SELECT media_id, frame_idx, round_even(frame_idx / 25.0 * 1000, 0)::BIGINT AS \"Time\", " + ", ".join(f'any_value(px) FILTER (part = {k}) AS "{n} X", any_value(py) FILTER (part = {k}) AS "{n} Y"' for k, n in PARTS.items()) + " FROM kp GROUP BY 1, 2")
def pose_table(s, d):
    return V.pose_table(_keypoints(s, d), PARTS, FPS)


NAMED = "[" + ", ".join(f"'{n}'" for n in PARTS.values()) + "]"


@query(f"WITH p AS (SELECT DISTINCT l_orderkey AS model, {NAMED}[(l_linenumber - 1) % {len(PARTS)} + 1] AS name FROM lineitem), f AS (SELECT model, string_agg(lower(name), ',') AS t FROM p GROUP BY 1) SELECT model, " + ", ".join("(" + " AND ".join(f"regexp_matches(t, '{'|'.join(words)}')" for words in groups) + f") AS {name}" for name, groups in V.FAMILIES.items()) + " FROM f")
def pose_features(s, d):
    """Each order as a model whose parts are its lines; which families of parts it has."""
    names = F.array(*[F.lit(n) for n in PARTS.values()])
    parts = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("model"), F.get(names, ((F.col("l_linenumber") - 1) % len(PARTS)).cast("int")).alias("name"))
    return V.pose_families(parts.distinct())


@query(f"WITH {PX}, m AS (SELECT media_id, frame_idx, arg_max(px, v * 100 - y * 8 - x) AS b FROM px GROUP BY 1, 2) SELECT media_id, frame_idx, CASE WHEN b.v > 200 THEN b.x / 8 END AS x, CASE WHEN b.v > 200 THEN b.y / 8 END AS y, b.v AS p FROM m")
def heatmap_argmax(s, d):
    return V.heatmap_peaks(A.pixels(s, d), W, H, 200)


@query(f"WITH {PX}, n AS (SELECT media_id, max(frame_idx) + 1 AS frames FROM px GROUP BY 1) SELECT media_id, frames, floor(frames / 25)::INT AS seconds, printf('%02d:%02d:%06.3f', (frames / 25 // 3600)::INT, ((frames / 25 % 3600) // 60)::INT, frames / 25 % 60) AS duration, 25 AS fps, ceil(frames / 16)::INT AS rows FROM n")
def clip_stats(s, d):
    return V.clip_stats(A.pixels(s, d), FPS, 16)


# Facts and functions

EV = "ev AS (SELECT event_id, (props->>'$.k')::INT AS k FROM events)"


@query(f"WITH {EV} SELECT event_id AS media_id, CASE WHEN k % 5 = 0 THEN k * 2 + 50 ELSE k + 100 END AS width, CASE WHEN k % 5 = 0 THEN k + 100 ELSE k * 2 + 50 END AS height, CASE WHEN k % 2 = 0 THEN 25.0 ELSE 29.97 END::DOUBLE AS fps, {r('(event_id // 3600 % 24) * 3600 + (event_id // 60 % 60) * 60 + event_id % 60 + k / 100::DOUBLE')} AS duration, k % 3 = 0 AS has_audio FROM ev")
def probe_facts(s, d):
    """Facts read out of printed text; the SQL has them from where the text was made."""
    return rounded(probe.facts(A.probes(s, d)))


@query(f"WITH {PX}, n AS (SELECT media_id, max(frame_idx) + 1 AS n FROM px GROUP BY 1) SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 7 ELSE n END::BIGINT AS frames FROM n")
def frame_counts(s, d):
    """Containers of even clips say 7, those of others don't say."""
    px = A.pixels(s, d)
    said = px.select("media_id").distinct().select("media_id", F.when(F.col("media_id") % 2 == 0, "7").alias("nb_frames"))
    return probe.frame_counts(said, px)


@query("SELECT event_id, event_type AS a, value > 50 AS b, user_id::VARCHAR AS c FROM events")
def side_data(s, d):
    """Two maps of a stream merged into one."""
    e = A.table(s, d, "events")
    both = F.map_concat(F.create_map(F.lit("a"), F.col("event_type"), F.lit("c"), F.col("user_id").cast("string")), F.create_map(F.lit("b"), (F.col("value") > 50).cast("string")))
    found = e.select("event_id", both.alias("m"))
    return found.select("event_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").cast("boolean").alias("b"), F.element_at("m", "c").alias("c"))


@query(f"WITH {SIG} SELECT media_id, n, {r('coalesce((y - min(y) OVER w) * 4 / nullif(max(y) OVER w - min(y) OVER w, 0), 0) - 2')} AS y FROM sig WINDOW w AS (PARTITION BY media_id)")
def scale_series(s, d):
    return rounded(X.scale_array(A.signal(s, d).select("media_id", "n", "y"), ["media_id"], "y", -2.0, 2.0))


BOXES = "SELECT l_orderkey AS frame_idx, l_linenumber AS box, l_quantity AS x1, l_linenumber::DOUBLE AS y1, l_quantity + floor(l_discount * 100) AS x2, l_linenumber + floor(l_tax * 100) AS y2 FROM lineitem"


@query(f"SELECT frame_idx, box, round_even(x1 - (x2 - x1) * (1.3::DOUBLE - 1.0), 0)::INT AS x1, round_even(y1 - (y2 - y1) * (1.3::DOUBLE - 1.0), 0)::INT AS y1, round_even(x2 + (x2 - x1) * (1.3::DOUBLE - 1.0), 0)::INT AS x2, round_even(y2 + (y2 - y1) * (1.3::DOUBLE - 1.0), 0)::INT AS y2 FROM ({BOXES})")
def scale_boxes(s, d):
    return X.scale_boxes(A.boxes(s, d).drop("score"), 1.3)


@query("SELECT o_orderkey, ceil(o_custkey * 1000 * 8 / (2147483647 / (480 + 128.0::DOUBLE) - 1024))::BIGINT AS skip_x, ceil(o_custkey * 1000 / (2147483647 / (640 * 8 + 1024.0::DOUBLE) - 128))::BIGINT AS skip_y FROM orders")
def skip_factors(s, d):
    x, y = X.skip_factors(F.lit(640), F.lit(480), F.col("o_custkey") * 1000)
    return A.table(s, d, "orders").select("o_orderkey", x.alias("skip_x"), y.alias("skip_y"))


@query(f"WITH {CPX} SELECT media_id, frame_idx, 3 AS planes FROM cpx GROUP BY 1, 2 UNION ALL SELECT media_id + 1000, frame_idx, 1 FROM clip")
def plane_counts(s, d):
    gray = A.pixels(s, d).select((F.col("media_id") + 1000).alias("media_id"), "frame_idx", F.lit(0).alias("c"))
    both = A.colours(s, d).select("media_id", "frame_idx", "c").unionByName(gray)
    return both.groupBy("media_id", "frame_idx").agg((F.max("c") + 1).alias("planes"))


PROJECTIONS = ("ERP", "e", "Equirectangular", "Fisheye", "BALL", "cube")


@query("SELECT event_id, CASE lower(p) WHEN 'erp' THEN 'equirect' WHEN 'e' THEN 'equirect' WHEN 'equirectangular' THEN 'equirect' WHEN 'fisheye' THEN 'fisheye' WHEN 'ball' THEN 'ball' END AS name FROM (SELECT event_id, " + "[" + ", ".join(f"'{x}'" for x in PROJECTIONS) + "][event_id % 7 + 1] AS p FROM events)")
def projection_names(s, d):
    """A name of a projection for each event, one in seven without."""
    given = F.get(F.array(*[F.lit(x) for x in PROJECTIONS]), (F.col("event_id") % 7).cast("int"))
    return A.table(s, d, "events").select("event_id", probe.projection(given).alias("name"))


@query("WITH l AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1) SELECT k, len(keys)::BIGINT AS n, keys[1] AS first, list_sum(keys[2:3])::BIGINT AS slice FROM l")
def list_slices(s, d):
    """Nested lists of a customer's orders flattened, and items and slices of the result."""
    nested = A.table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_orderkey").alias("own")).groupBy("o_custkey").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("keys"))
    return nested.select(F.col("o_custkey").alias("k"), F.size("keys").cast("long").alias("n"), F.get("keys", F.lit(0)).alias("first"), F.when(F.size("keys") > 1, F.aggregate(F.slice("keys", 2, 2), F.lit(0).cast("long"), lambda a, x: a + x)).alias("slice"))


GRADS = f"{PX}, gr AS (SELECT *, coalesce((lead(v) OVER (PARTITION BY media_id, frame_idx, y ORDER BY x) - lag(v) OVER (PARTITION BY media_id, frame_idx, y ORDER BY x)) / 2.0, 0) AS ix, coalesce((lead(v) OVER (PARTITION BY media_id, frame_idx, x ORDER BY y) - lag(v) OVER (PARTITION BY media_id, frame_idx, x ORDER BY y)) / 2.0, 0) AS iy FROM px)"


@query(f"""WITH RECURSIVE {GRADS}, q AS ({near(3, 'struct_pack(a := sum(ix * ix), b := sum(ix * iy), c := sum(iy * iy))', 'gr')}), st AS (SELECT media_id, frame_idx, y, x, round((v.a + v.c) / 2 - sqrt(((v.a - v.c) / 2) ** 2 + v.b * v.b), 6) AS strength FROM q),
 o AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame_idx ORDER BY strength DESC, y, x) AS k FROM (SELECT *, max(strength) OVER (PARTITION BY media_id, frame_idx) AS top FROM st) WHERE strength > 0 AND strength >= 0.3 * top),
 step AS (SELECT media_id, frame_idx, k, [struct_pack(y, x)] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.media_id, o.frame_idx, o.k, CASE WHEN len(list_filter(kept, lambda p: sqrt((p.y - o.y) ** 2 + (p.x - o.x) ** 2) < 2)) = 0 THEN list_append(kept, struct_pack(o.y, o.x)) ELSE kept END FROM step JOIN o ON o.media_id = step.media_id AND o.frame_idx = step.frame_idx AND o.k = step.k + 1),
 last AS (SELECT media_id, frame_idx, arg_max(kept, k) AS kept FROM step GROUP BY 1, 2) SELECT o.media_id, o.frame_idx, o.y, o.x, strength FROM o JOIN (SELECT media_id, frame_idx, unnest(kept) AS p FROM last) l ON l.media_id = o.media_id AND l.frame_idx = o.frame_idx AND l.p.y = o.y AND l.p.x = o.x""")
def corners(s, d):
    return C.corners(A.pixels(s, d))


@query()
def sparse_tracks(s, d):
    """Corners of each clip's first frame carried by the flow; tested step by step."""
    px = A.pixels(s, d)
    return rounded(C.track(C.corners(P.frame_at(px, 0)), P.window_flow(px, 5)))


@query()
def beat_track(s, d):
    """Beats of each user's events as onsets; tested on clicks of a known tempo."""
    return V.beats(A.signal(s, d).select("media_id", "n", "y"), 4.0, 60.0)


def warp_steps(s, d):
    """Beats of sound: every fourth sample; of the picture: values over 150; all at one sample a second."""
    sig = A.signal(s, d).select("media_id", F.col("n").cast("int").alias("n"), "y")
    lengths = sig.groupBy("media_id").agg(F.count("*").alias("len"))
    steps = lambda own, kind: S.intervals(own.select("media_id", "n"), lengths).select("media_id", F.lit(kind).alias("kind"), "k", F.col("step").cast("double").alias("step"))
    return steps(sig.where("n % 4 = 3"), "audio").unionByName(steps(sig.where("y > 150"), "visual"))


@query()
def warp_sync(s, d):
    """Which sample is shown at each moment after sound and picture beats are brought together; tested against a plain loop."""
    return V.warp_frames(V.synchronised(warp_steps(s, d)), 1.0)

