"""Operators on colour pixel rows (media_id, frame_idx, y, x, c, v); channels are blue, green, red: 0, 1, 2."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import FRAME

PLACE = [*FRAME, "y", "x"]
#: The weights of blue, green and red in a gray level.
GRAY = (0.114, 0.587, 0.299)


def channels(px: DataFrame, keys: list[str] = PLACE) -> DataFrame:
    """A row per place with the levels b, g and r; a channel that is missing is 0."""
    level = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, F.col("v"))), F.lit(0))
    return px.groupBy(*keys).agg(level(0).alias("b"), level(1).alias("g"), level(2).alias("r"))


def grayscale(px: DataFrame) -> DataFrame:
    b, g, r = GRAY
    return channels(px).select(*PLACE, F.rint(b * F.col("b") + g * F.col("g") + r * F.col("r")).cast("int").alias("v"))


def per_channel(px: DataFrame) -> DataFrame:
    """Each channel as a clip of its own: (media_id, c) is one struct key, so that gray operators take it."""
    return px.select(F.struct("media_id", "c").alias("media_id"), "frame_idx", "y", "x", "v")


def from_channels(df: DataFrame) -> DataFrame:
    return df.select("media_id.media_id", "media_id.c", *[c for c in df.columns if c != "media_id"])


def videogram(px: DataFrame, axis: str) -> DataFrame:
    """Mean level of each channel along one axis."""
    return px.groupBy(*FRAME, F.col(axis).alias("pos"), "c").agg(F.avg("v").alias("v"))


def pixel_array(px: DataFrame, width: int) -> DataFrame:
    """A frame's mean colour as one pixel of an image of this width."""
    means = px.groupBy(*FRAME, "c").agg(F.floor(F.avg("v")).cast("int").alias("v"))
    return means.select("media_id", F.floor(F.col("frame_idx") / width).cast("int").alias("row"), (F.col("frame_idx") % width).alias("col"), "c", "v")


def blend(px: DataFrame) -> DataFrame:
    return px.groupBy("media_id", "y", "x", "c").agg(F.avg("v").alias("average"), F.max("v").alias("lighten"), F.min("v").alias("darken"))


def equalise_value(gram: DataFrame) -> DataFrame:
    """Colour grams (media_id, frame_idx, pos, c, v) with their value, the greatest channel, equalised over the clip; hue and saturation stay."""
    place = ["media_id", "frame_idx", "pos"]
    own = channels(gram, place).withColumn("most", F.greatest("b", "g", "r"))
    counts = own.groupBy("media_id", "most").agg(F.count("*").alias("n"))
    order = Window.partitionBy("media_id").orderBy("most")  # 256 levels at most
    cdf = counts.select("media_id", "most", F.sum("n").over(order).alias("cdf"), F.first("n").over(order).alias("low"), F.sum("n").over(Window.partitionBy("media_id")).alias("all"))
    to = F.when(F.col("all") > F.col("low"), F.round(255 * (F.col("cdf") - F.col("low")) / (F.col("all") - F.col("low")))).otherwise(F.col("most"))
    found = own.join(cdf.select("media_id", "most", to.cast("int").alias("to")), ["media_id", "most"])
    scaled = lambda c: F.when(F.col("most") > 0, F.rint(F.col(c) * F.col("to") / F.col("most"))).otherwise(F.col("to")).cast("int")
    return found.select(*place, F.posexplode(F.array(scaled("b"), scaled("g"), scaled("r"))).alias("c", "v"))


def to_hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 179, two degrees a step), saturation and value (0 to 255) of 8-bit levels, by fixed-point division to 12 bits."""
    v = F.greatest(b, g, r)
    away = v - F.least(b, g, r)
    whole = lambda x: F.floor((x + 2048) / 4096).cast("int")
    share = lambda n, of: F.when(of > 0, F.rint(F.lit(n * 4096.0) / of)).otherwise(0.0)
    s = whole(away * share(255.0, v))
    turn = whole(F.when(v == r, g - b).when(v == g, b - r + 2 * away).otherwise(r - g + 4 * away) * share(30.0, away))
    return F.when(turn < 0, turn + 180).otherwise(turn), s, v


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """The levels b, g and r of 8-bit hue, saturation and value."""
    sector, part, pale = F.floor(h / 30.0).cast("int") % 6, h / 30.0 - F.floor(h / 30.0), s / 255.0
    level = lambda x: F.rint(v * x).cast("int")
    full, low, falling, rising = level(F.lit(1.0)), level(1 - pale), level(1 - pale * part), level(1 - pale * (1 - part))
    pick = lambda *by: F.get(F.array(*by), sector)
    return pick(low, low, rising, full, full, falling), pick(rising, full, full, falling, low, low), pick(full, falling, low, low, rising, full)


def equalise_hsv(gram: DataFrame) -> DataFrame:
    """Colour grams (media_id, frame_idx, pos, c, v) with the histogram of their value equalised over the clip, by way of 8-bit hue, saturation and value.

    A clip of one value alone stays as it is, but for the steps of hue and saturation.
    """
    place = ["media_id", "frame_idx", "pos"]
    h, s, v = to_hsv(F.col("b"), F.col("g"), F.col("r"))
    own = channels(gram, place).select(*place, h.alias("h"), s.alias("s"), v.alias("value"))
    counts = own.groupBy("media_id", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("media_id").orderBy("value")  # 256 levels at most
    cdf = counts.select("media_id", "value", F.sum("n").over(order).alias("cdf"), F.first("n").over(order).alias("low"), F.sum("n").over(Window.partitionBy("media_id")).alias("all"))
    to = F.when(F.col("all") > F.col("low"), F.rint(255.0 * (F.col("cdf") - F.col("low")) / (F.col("all") - F.col("low")))).otherwise(F.col("value")).cast("int")
    found = own.join(cdf.select("media_id", "value", to.alias("to")), ["media_id", "value"])
    return found.select(*place, F.posexplode(F.array(*from_hsv(F.col("h"), F.col("s"), F.col("to")))).alias("c", "v"))


def flow_colours(flow: DataFrame) -> DataFrame:
    """(hue, value) of each pixel's flow: half its angle in degrees, and its length between the frame's least and greatest as 0..255."""
    angle = F.atan2("fy", "fx")
    turn = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    found = flow.select(*PLACE, (turn * 90 / math.pi).alias("hue"), F.hypot("fx", "fy").alias("mag"))
    ends = found.groupBy(*FRAME).agg(F.min("mag").alias("lo"), F.max("mag").alias("hi"))
    value = F.when(F.col("hi") > F.col("lo"), (F.col("mag") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return found.join(ends, FRAME).select(*PLACE, "hue", value.alias("value"))


def repeat_empty(px: DataFrame) -> DataFrame:
    """Frames without any level over 0 show the last one that has some; a clip's first frame stays."""
    own = px.groupBy(*FRAME).agg(F.sum("v").alias("sum"))
    order = Window.partitionBy("media_id").orderBy("frame_idx")
    shown = F.when((F.col("sum") > 0) | (F.row_number().over(order) == 1), F.col("frame_idx"))
    marked = own.select("media_id", "frame_idx", shown.alias("shown"))
    source = marked.select("media_id", "frame_idx", F.last("shown", ignorenulls=True).over(order).alias("source"))
    pixels = px.withColumnRenamed("frame_idx", "source")
    return source.join(pixels, ["media_id", "source"]).drop("source")


def subtract_background(px: DataFrame, thresh: float, curves: float = 0.15, colour: int = 255, background: DataFrame | None = None) -> DataFrame:
    """Pixels merged over a plain colour by how much they differ from the background, the clip's average image if none is given.

    Differences not over thresh count as 0; a curve takes those under a share of full level
    to 0, those a tenth above it to full, and is straight between. background: (media_id, y, x, bg).
    """
    pixel = ["media_id", "y", "x"]
    bg = background if background is not None else px.groupBy(*pixel).agg(F.floor(F.avg("v")).cast("int").alias("bg"))
    diff = F.abs(F.col("v") - F.col("bg"))
    over = F.when(diff > thresh * 255, diff).otherwise(0) / 255
    low = round(curves * 0.7 + 0.1, 2)
    mask = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (over - low) / 0.1))
    return px.join(bg, pixel).select(*PLACE, F.rint(colour * (1 - mask) + F.col("v") * mask).cast("int").alias("v"))


def equaliser(v: Column, contrast: float, brightness: float) -> Column:
    """Contrast and brightness in percent by a video equaliser: a gain about the middle level, and an offset; 0 and 0 change nothing."""
    contrast, brightness = max(-100.0, min(100.0, contrast)), max(-100.0, min(100.0, brightness))
    gain = 1 + contrast * (1.3 if contrast > 0 else 1) / 100
    offset = (0.04 * contrast / 100 if contrast > 0 else 0) + brightness / 100
    level = ((v / 255 - 0.5) * gain + 0.5 + offset) * 255
    return F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))).cast("int")


def palette(spark, colours: list[tuple[int, int, int]], size: int = 256) -> DataFrame:
    """(i, r, g, b): so many colours, straight between the given ones."""
    given = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", c)]) for c in colours])
    at = F.col("i") * (len(colours) - 1) / (size - 1)
    low = F.floor(at).cast("int")
    part = lambda n: F.floor((1 - (at - low)) * F.get(given, low)[n] + (at - low) * F.coalesce(F.get(given, low + 1)[n], F.lit(0))).cast("int").alias(n)
    return spark.range(size).select(F.col("id").cast("int").alias("i")).select("i", *[part(n) for n in "rgb"])


def corners(px: DataFrame, k: int = 3, most: int = 100, quality: float = 0.3, distance: float = 2.0) -> DataFrame:
    """(media_id, frame_idx, y, x, strength): corners by the lesser eigenvalue of summed gradients over k x k.

    Kept are those of at least `quality` of the frame's strongest; of these by falling
    strength, then place, each that is at least `distance` from all before, at most `most`.
    """
    import numpy as np
    import pandas as pd

    from .frames import box_sums, by_frame

    across, down = (Window.partitionBy(*FRAME, a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    slope = lambda w: F.coalesce((F.lead("v").over(w) - F.lag("v").over(w)) / 2, F.lit(0.0))
    g = by_frame(px).select(*PLACE, slope(across).alias("ix"), slope(down).alias("iy"))
    sums = box_sums(g, k, a=F.col("ix") * F.col("ix"), b=F.col("ix") * F.col("iy"), c=F.col("iy") * F.col("iy"))
    least = (F.col("a") + F.col("c")) / 2 - F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    strong = sums.select(*PLACE, F.round(least, 6).alias("strength"))
    top = strong.groupBy(*FRAME).agg((F.max("strength") * quality).alias("bound"))
    strong = strong.join(top, FRAME).where((F.col("strength") > 0) & (F.col("strength") >= F.col("bound"))).drop("bound")

    def apart(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["strength", "y", "x"], ascending=[False, True, True])
        at, kept = frame[["y", "x"]].to_numpy(float), []
        for i in range(len(at)):
            if len(kept) < most and all(np.hypot(*(at[i] - at[j])) >= distance for j in kept):
                kept.append(i)
        return frame.iloc[kept]

    return strong.groupBy(*FRAME).applyInPandas(apart, strong.schema)


def track(points: DataFrame, flow: DataFrame) -> DataFrame:
    """(media_id, track, frame_idx, y, x): points of each clip's first frame carried from frame to frame by the flow at the nearest pixel.

    points: (media_id, y, x); flow: (media_id, frame_idx, y, x, fx, fy) from a frame to the
    next. A track ends where it leaves the frame. Each step needs the one before, so a clip
    is one task and its flow has to fit there; clips are spread.
    """
    import numpy as np
    import pandas as pd

    def follow(start: pd.DataFrame, flow: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values(["y", "x"]).reset_index(drop=True)
        steps = {t: dict(zip(zip(f["y"], f["x"]), zip(f["fy"], f["fx"]))) for t, f in flow.groupby("frame_idx")}
        rows = []
        for k, (y, x) in enumerate(start[["y", "x"]].to_numpy(float)):
            t = 0
            rows.append((k, t, y, x))
            while (move := steps.get(t, {}).get((int(np.floor(y + 0.5)), int(np.floor(x + 0.5))))) is not None:
                y, x, t = y + move[0], x + move[1], t + 1
                rows.append((k, t, y, x))
        found = pd.DataFrame(rows, columns=["track", "frame_idx", "y", "x"])
        found.insert(0, "media_id", start["media_id"].iloc[0] if len(start) else None)
        return found

    kind = points.schema["media_id"].dataType.simpleString()
    own = points.select("media_id", "y", "x")
    return own.groupBy("media_id").cogroup(flow.join(own.select("media_id").distinct(), "media_id", "left_semi").groupBy("media_id")).applyInPandas(follow, f"media_id {kind}, track int, frame_idx int, y double, x double")
