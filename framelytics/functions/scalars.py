"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roundup(num: Column, multiple: int) -> Column:
    """The next multiple at or above the whole part of num."""
    return (F.ceil(num.cast("long") / multiple) * multiple).cast("long")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def scale_num(v: Column, in_low: float, in_high: float, out_low: float, out_high: float) -> Column:
    """Linear map that extrapolates outside the input range."""
    return (v - in_low) * (out_high - out_low) / (in_high - in_low) + out_low


def frame2ms(frame: Column, fps: float) -> Column:
    """Milliseconds, halves to even."""
    return F.rint(frame / fps * 1000).cast("long")


def str2sec(text: Column) -> Column:
    """Seconds of HH:MM:SS.ff, MM:SS or SS."""
    parts = F.reverse(F.split(text, ":"))
    return F.aggregate(F.transform(parts, lambda p, i: p.cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def duration_string(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def wrap_str(text: Column, mark: str = '"') -> Column:
    """The text in marks if it has a blank or a parenthesis."""
    return F.when(text.rlike("[ ()]"), F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)


def unwrap_str(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"]|['\"]$", "")


def box_ratio(box_w: Column, box_h: Column, w: Column, h: Column) -> Column:
    """How much to shrink a frame to fit a box; a tenth smaller if it has to shrink."""
    least = F.least(box_w / w, box_h / h)
    return F.when(least < 1, least * 0.9).otherwise(F.lit(1.0))


def iou(a: str, b: str) -> Column:
    """Overlap of boxes a and b (prefixes of x1, y1, x2, y2 columns), each edge's last pixel included."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo + 1)
    c = lambda p, k: F.col(f"{p}{k}")
    inner = side(F.greatest(c(a, "x1"), c(b, "x1")), F.least(c(a, "x2"), c(b, "x2"))) * side(F.greatest(c(a, "y1"), c(b, "y1")), F.least(c(a, "y2"), c(b, "y2")))
    area = lambda p: (c(p, "x2") - c(p, "x1") + 1) * (c(p, "y2") - c(p, "y1") + 1)
    return inner / (area(a) + area(b) - inner)


def hz_to_mel(hz: Column) -> Column:
    """The Slaney scale: linear to 1 kHz, then logarithmic."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + 27 * F.ln(hz / 1000) / F.ln(F.lit(6.4)))


def metres(pixels: Column, side: float, angle: float, distance: float) -> Column:
    """A length in pixels at a distance, from the camera's angle of view over a side of so many pixels."""
    return pixels / (((side / 2) / F.tan(F.lit(angle / 2))) / distance)


def scale_array(df, keys: list[str], value: str, out_low: float, out_high: float):
    """df with value scaled, per keys, so that its least becomes out_low and its greatest out_high; where all are equal, out_low."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) * (out_high - out_low) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0) + out_low
    return df.join(ends, keys).withColumn(value, scaled).drop("_lo", "_hi")


def scale_boxes(boxes, scale: float):
    """Boxes grown on each side by scale - 1 times their own side, to whole pixels, halves to even."""
    w, h = (F.col("x2") - F.col("x1")) * (scale - 1), (F.col("y2") - F.col("y1")) * (scale - 1)
    grown = {"x1": F.col("x1") - w, "y1": F.col("y1") - h, "x2": F.col("x2") + w, "y2": F.col("y2") + h}
    return boxes.withColumns({k: F.rint(v).cast("int") for k, v in grown.items()})


def skip_factors(width: Column, height: Column, frames: Column) -> tuple[Column, Column]:
    """Of how many frames one has to be taken, so that grams along x and along y stay within the size of a signed 32-bit image."""
    most = 2147483647
    x = F.ceil(frames * 8 / (most / (height + 128.0) - 1024))
    y = F.ceil(frames / (most / (width * 8 + 1024.0) - 128))
    return x.cast("long"), y.cast("long")


def frame_groups(frames: int, parts: int) -> list[tuple[int, int]]:
    """(first, count) of so many runs of frames; each but the last has one frame more, which the next begins with."""
    size = -(-frames // parts)
    return [(k, min(size, frames - k) + (k + size < frames)) for k in range(0, frames, size)]
