"""Operators on pixel rows (media_id, frame_idx, y, x, v): selection, filters, motion and grams.

Windows are partitioned by pixel or by frame, so no clip is ever in one task; filters on
frames come before windows, as a filter does not pass below a lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FRAME, PIXEL = ["media_id", "frame_idx"], ["media_id", "y", "x"]


def trim(px: DataFrame, start: float, end: float, fps: float) -> DataFrame:
    """Frames of [start, end) seconds, numbered from 0; reversed bounds are swapped, end 0 is the end of the clip."""
    if end and end < start:
        start, end = end, start
    first, last = int(-(-start * fps // 1)), int(-(-end * fps // 1))
    kept = px.where((F.col("frame_idx") >= first) & ((F.col("frame_idx") < last) if end else F.lit(True)))
    return kept.withColumn("frame_idx", F.col("frame_idx") - first)


def skip(px: DataFrame, n: int) -> DataFrame:
    """One of every n + 1 frames."""
    return px.where(F.col("frame_idx") % (n + 1) == 0).withColumn("frame_idx", F.floor(F.col("frame_idx") / (n + 1)).cast("int"))


def frame_at(px: DataFrame, frame: int | None = None, time: float | None = None, fps: float = 25.0) -> DataFrame:
    """One frame of each clip, by number or by time in seconds."""
    if (frame is None) == (time is None):
        raise ValueError("give either a frame or a time")
    return px.where(F.col("frame_idx") == (frame if frame is not None else int(round(time * fps))))


def keyframes(px: DataFrame, coded: DataFrame) -> DataFrame:
    """The frames that are coded whole (type I), numbered anew. coded: (media_id, frame_idx, type), each frame once."""
    own = coded.where("type = 'I'").select("media_id", "frame_idx")
    order = Window.partitionBy("media_id").orderBy("frame_idx")
    numbered = own.withColumn("k", F.row_number().over(order) - 1)
    return px.join(numbered, FRAME).select("media_id", F.col("k").alias("frame_idx"), "y", "x", "v")


def rotate(px: DataFrame, angle: float, width: int, height: int, fill: int = 0) -> DataFrame:
    """Turned clockwise by so many radians about the centre, on the same canvas: each place shows the nearest source pixel, or fill.

    The map of places is as large as a frame, whatever the number of frames.
    """
    import math

    cx, cy, c, s = (width - 1) / 2, (height - 1) / 2, math.cos(angle), math.sin(angle)
    places = lambda id_: ((id_ % width).cast("int").alias("x"), F.floor(id_ / width).cast("int").alias("y"))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    # A nudge decides halves the same way on every machine.
    source = {"sx": F.floor(dx * c + dy * s + cx + 0.5 + 1e-9).cast("int"), "sy": F.floor(dy * c - dx * s + cy + 0.5 + 1e-9).cast("int")}
    every = px.sparkSession.range(width * height).select(*places(F.col("id"))).withColumns(source)
    turned = px.withColumnsRenamed({"y": "sy", "x": "sx"}).join(F.broadcast(every), ["sy", "sx"]).select(*FRAME, "y", "x", "v")  # a row a pixel of one frame
    outside = px.where("y = 0 AND x = 0").select(*FRAME, F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("id")).select(*FRAME, *places(F.col("id"))).withColumns(source)
    outside = outside.where(~(F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1))).select(*FRAME, "y", "x", F.lit(fill).cast(px.schema["v"].dataType).alias("v"))
    return turned.unionByName(outside)


def fixed_frames(px: DataFrame, frames: int) -> DataFrame:
    """Each clip resampled to so many frames: output k shows frame floor(k * length / frames)."""
    length = px.groupBy("media_id").agg((F.max("frame_idx") + 1).alias("len"))
    picks = length.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("k"), "len")
    picks = picks.select(F.col("media_id").alias("m"), "k", F.floor(F.col("k") * F.col("len") / frames).alias("source"))
    return px.join(picks, (px["media_id"] == picks["m"]) & (px["frame_idx"] == picks["source"])).select("media_id", F.col("k").alias("frame_idx"), "y", "x", "v")


def rotate90(px: DataFrame, height: int) -> DataFrame:
    """A quarter turn clockwise."""
    return px.select("media_id", "frame_idx", F.col("x").alias("y"), (height - 1 - F.col("y")).alias("x"), "v")


def contrast(px: DataFrame, contrast: float, brightness: float) -> DataFrame:
    """Contrast and brightness in percent, clipped to 0..255."""
    c, b = max(-100, min(100, contrast)), max(-100, min(100, brightness))
    v = F.col("v") * (1.27 * c / 127 + 1) - 1.27 * c + 2.55 * b
    return px.withColumn("v", F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int"))


def crop(px: DataFrame, width: int, height: int, x: int, y: int) -> DataFrame:
    kept = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return kept.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def invert(px: DataFrame) -> DataFrame:
    return px.withColumn("v", 255 - F.col("v"))


def grid_sample(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every n-th frame with its cell in a contact sheet, n = length // cells."""
    length = px.groupBy("media_id").agg((F.max("frame_idx") + 1).alias("len"))
    nth = F.greatest(F.lit(1), F.floor(F.col("len") / (rows * cols))).cast("int")
    placed = px.join(length, "media_id").where((F.col("frame_idx") % nth == 0) & (F.col("frame_idx") / nth < rows * cols))
    k = F.floor(F.col("frame_idx") / nth).cast("int")
    return placed.select("media_id", "frame_idx", F.floor(k / cols).cast("int").alias("row"), (k % cols).alias("col"), "y", "x", "v")


def difference(px: DataFrame) -> DataFrame:
    """Absolute change of each pixel since the frame before; a clip of T frames gives T - 1."""
    order = Window.partitionBy(*PIXEL).orderBy("frame_idx")
    changed = px.withColumn("d", F.abs(F.col("v") - F.lag("v").over(order))).where(F.col("d").isNotNull())
    return changed.select("media_id", (F.col("frame_idx") - 1).alias("frame_idx"), "y", "x", F.col("d").alias("v"))


def threshold(px: DataFrame, thresh: float, binary: bool = False) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") > thresh * 255, F.lit(255) if binary else F.col("v")).otherwise(0))


def _around(k: int) -> tuple[WindowSpec, WindowSpec]:
    """Windows over k places of a row and of a column of a frame; an even k has one more before than after."""
    before, after = k // 2, k - 1 - k // 2
    along, down = Window.partitionBy(*FRAME, "y").orderBy("x"), Window.partitionBy(*FRAME, "x").orderBy("y")
    return along.rangeBetween(-before, after), down.rangeBetween(-before, after)


def by_frame(px: DataFrame) -> DataFrame:
    """px dealt by frames once, which suits windows over rows and over columns alike."""
    return px.repartition(*FRAME)


def box_sums(px: DataFrame, k: int, **values: Column) -> DataFrame:
    """px with the sum of each value over k x k around each pixel, and n, how many of these places are inside; one axis after the other."""
    along, down = _around(k)
    values = {**values, "n": F.lit(1)}
    once = by_frame(px).select("*", *[F.sum(v).over(along).alias(f"_{name}") for name, v in values.items()])
    return once.select(*px.columns, *[F.sum(f"_{name}").over(down).alias(name) for name in values])


def erode(px: DataFrame, k: int) -> DataFrame:
    along, down = _around(k)
    return by_frame(px).withColumn("v", F.min("v").over(along)).withColumn("v", F.min("v").over(down))


def median(px: DataFrame, k: int) -> DataFrame:
    """k x k median with zeros outside the frame. Values are gathered along rows, then the gathered along columns."""
    along, down = _around(k)
    near = by_frame(px).withColumn("near", F.collect_list("v").over(along)).withColumn("near", F.flatten(F.collect_list("near").over(down)))
    padded = F.sort_array(F.concat("near", F.array_repeat(F.lit(0).cast(px.schema["v"].dataType), k * k - F.size("near"))))
    return near.withColumn("v", F.get(padded, F.lit(k * k // 2))).drop("near")


def box_blur(px: DataFrame, k: int) -> DataFrame:
    """Mean over the k x k places that are inside, whole part."""
    return box_sums(px, k, s=F.col("v")).withColumn("v", F.floor(F.col("s") / F.col("n")).cast("int")).drop("s", "n")


def adaptive_mean(px: DataFrame, k: int, c: int) -> DataFrame:
    """255 where a pixel exceeds its neighbourhood's mean less c."""
    return box_sums(px, k, s=F.col("v")).withColumn("v", F.when(F.col("v") > F.col("s") / F.col("n") - c, 255).otherwise(0)).drop("s", "n")


def gaussian_weights(k: int) -> list[float]:
    """Weights of k places that add up to 1; the deviation grows with k in the usual way of image libraries."""
    import math

    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (k - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [x / sum(raw) for x in raw]


def _smoothed(px: DataFrame, value: str, line: str, at: str, k: int) -> DataFrame:
    """value as its weighted mean along the axis `at`, edge values going on beyond the frame. A row or a column is one array."""
    lines = px.groupBy(*FRAME, line).agg(F.array_sort(F.collect_list(F.struct(at, value, *[c for c in px.columns if c not in (*FRAME, line, at, value)]))).alias("cells"))
    level = lambda i: F.get("cells", F.least(F.greatest(i, F.lit(0)), F.size("cells") - 1))[value]
    mean = lambda cell, i: cell.withField(value, sum((w * level(i + j - k // 2) for j, w in enumerate(gaussian_weights(k))), F.lit(0.0)))
    return lines.select(*FRAME, line, F.explode(F.transform("cells", mean)).alias("cell")).select(*FRAME, line, "cell.*")


def adaptive_gaussian(px: DataFrame, k: int = 11, c: int = 2) -> DataFrame:
    """255 where a pixel exceeds the rounded Gaussian mean around it less c."""
    both = px.select(*FRAME, "y", "x", "v", F.col("v").cast("double").alias("mean"))
    both = _smoothed(_smoothed(both, "mean", "y", "x", k), "mean", "x", "y", k)
    return both.select(*FRAME, "y", "x", F.when(F.col("v") - F.rint("mean") > -c, 255).otherwise(0).alias("v"))


def subtract_background(px: DataFrame, thresh: float) -> DataFrame:
    """What differs from the clip's average image by more than thresh; other pixels are 0."""
    mean = px.groupBy(*PIXEL).agg(F.floor(F.avg("v")).cast("int").alias("bg"))
    return px.join(mean, PIXEL).select(*FRAME, "y", "x", F.when(F.abs(F.col("v") - F.col("bg")) > thresh * 255, F.col("v")).otherwise(0).alias("v"))


def motion(px: DataFrame, width: int, height: int, fps: float) -> DataFrame:
    """Per frame of motion pixels: Time, Qom and the centroid, its y upwards; no motion gives (0, height)."""
    mass = F.sum("v")
    found = px.groupBy(*FRAME).agg(mass.cast("long").alias("Qom"), F.sum(F.col("x") * F.col("v")).alias("sx"), F.sum(F.col("y") * F.col("v")).alias("sy"))
    where = lambda s: F.when(F.col("Qom") > 0, F.col(s) / F.col("Qom")).otherwise(0.0)
    time = F.rint(F.col("frame_idx") / fps * 1000).cast("long")
    return found.select(*FRAME, time.alias("Time"), "Qom", (where("sx") / width).alias("ComX"), ((height - where("sy")) / height).alias("ComY"))


def normalised_qom(moved: DataFrame) -> DataFrame:
    """Qom over the clip's greatest, 0 for a clip without motion."""
    most = moved.groupBy("media_id").agg(F.max("Qom").alias("most"))
    return moved.join(most, "media_id").withColumn("Qom", F.when(F.col("most") > 0, F.col("Qom") / F.col("most")).otherwise(0.0)).drop("most")


def motion_box(px: DataFrame, thresh: float, margin: int, width: int, height: int) -> DataFrame:
    """Per clip the box of all motion over the threshold, widened by a margin rounded up to fours and clamped."""
    m = -(-margin // 4) * 4
    box = difference(px).where(F.col("v") > thresh * 255).groupBy("media_id").agg(*[f("x").alias(f"{n}x") for n, f in (("lo", F.min), ("hi", F.max))], *[f("y").alias(f"{n}y") for n, f in (("lo", F.min), ("hi", F.max))])
    return box.select("media_id", F.greatest(F.lit(0), F.col("lox") - m).alias("x1"), F.greatest(F.lit(0), F.col("loy") - m).alias("y1"), F.least(F.lit(width - 1), F.col("hix") + m).alias("x2"), F.least(F.lit(height - 1), F.col("hiy") + m).alias("y2"))


def motiongram(px: DataFrame, axis: str) -> DataFrame:
    """Whole mean of motion pixels along one axis: a line per frame, after a line of zeros. axis: the one that stays."""
    lines = px.groupBy(*FRAME, F.col(axis).alias("pos")).agg(F.floor(F.avg("v")).cast("int").alias("v")).withColumn("frame_idx", F.col("frame_idx") + 1)
    zero = lines.select("media_id", F.lit(0).alias("frame_idx"), "pos", F.lit(0).alias("v")).distinct()
    return zero.unionByName(lines)


def gram_minmax(gram: DataFrame) -> DataFrame:
    """Stretched to 0..255 over the clip, whole part; a flat gram is 0."""
    ends = gram.groupBy("media_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(0)
    return gram.join(ends, "media_id").select("media_id", "frame_idx", "pos", v.cast("int").alias("v"))


def equalise(gram: DataFrame) -> DataFrame:
    """Histogram equalisation over the clip: 255 * (cdf - cdf of the least value) / (all - that)."""
    counts = gram.groupBy("media_id", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("media_id").orderBy("v")
    cdf = counts.withColumn("cdf", F.sum("n").over(order)).withColumn("low", F.first("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("media_id")))
    table = cdf.select("media_id", "v", F.when(F.col("all") > F.col("low"), F.round(255 * (F.col("cdf") - F.col("low")) / (F.col("all") - F.col("low")))).otherwise(F.col("v")).cast("int").alias("e"))
    return gram.join(table, ["media_id", "v"]).select("media_id", "frame_idx", "pos", F.col("e").alias("v"))


def videogram(px: DataFrame, axis: str) -> DataFrame:
    return px.groupBy(*FRAME, F.col(axis).alias("pos")).agg(F.avg("v").alias("v"))


def pixel_array(px: DataFrame, width: int) -> DataFrame:
    """A frame's mean level as one pixel of an image of this width."""
    means = px.groupBy(*FRAME).agg(F.floor(F.avg("v")).cast("int").alias("v"))
    return means.select("media_id", F.floor(F.col("frame_idx") / width).cast("int").alias("row"), (F.col("frame_idx") % width).alias("col"), "v")


def blend(px: DataFrame) -> DataFrame:
    """Average, lightest and darkest image of each clip."""
    return px.groupBy(*PIXEL).agg(F.avg("v").alias("average"), F.max("v").alias("lighten"), F.min("v").alias("darken"))


def history(px: DataFrame, weights: list[float]) -> DataFrame:
    """Whole weighted mean of a frame and those before it that exist, newest weight first."""
    order = Window.partitionBy(*PIXEL).orderBy("frame_idx")
    terms = [(w, F.lag("v", k).over(order)) for k, w in enumerate(weights)]
    total = sum((F.coalesce(w * t, F.lit(0.0)) for w, t in terms), F.lit(0.0))
    mass = sum((F.when(t.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, t in terms), F.lit(0.0))
    return px.select(*FRAME, "y", "x", F.floor(total / mass).cast("int").alias("v"))


def blend_pyramid(px: DataFrame, mode: str = "average") -> DataFrame:
    """(media_id, y, x, v): a clip's frames blended by twos, and the results again, until one is left; a last odd one falls out.

    So the frame left is of the first 2^k frames, where 2^k is the greatest power within the
    length, and blends that know no order or number of steps are one aggregation over them.
    """
    length = px.groupBy("media_id").agg((F.max("frame_idx") + 1).alias("len"))
    used = px.join(length, "media_id").withColumn("most", F.expr("cast(pow(2, floor(log2(len))) as int)")).where(F.col("frame_idx") < F.col("most"))
    if mode in ("lighten", "darken"):
        return used.groupBy(*PIXEL).agg((F.max if mode == "lighten" else F.min)("v").alias("v"))
    if mode not in ("average", "difference"):
        raise ValueError(f"unknown mode {mode}")
    join = (lambda a, b: F.floor((a + b) / 2).cast("int")) if mode == "average" else (lambda a, b: F.abs(a - b))
    line = used.groupBy(*PIXEL).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "v"))), lambda e: e["v"]).alias("line"))
    for _ in range(31):  # a line has under 2^31 frames; one of a single frame stays as it is
        twos = F.transform(F.sequence(F.lit(0), F.floor(F.size("line") / 2).cast("int") - 1), lambda k: join(F.get("line", 2 * k), F.get("line", 2 * k + 1)))
        line = line.withColumn("line", F.when(F.size("line") > 1, twos).otherwise(F.col("line")))
    return line.select(*PIXEL, F.get("line", F.lit(0)).alias("v"))


def exact_history(px: DataFrame, length: int, weights: list[float] | float = 1.0) -> DataFrame:
    """A clip's first frame as it is; then a frame and up to `length` before it, over a constant mass.

    The first weight is the frame's own; the next ones are those of the frames before it,
    from the oldest that is still there on. The mass counts 1 for each of length + 1
    frames, and what weights are over 1, also while there are fewer frames.
    """
    weights = [float(w) for w in (weights if isinstance(weights, list) else [weights])]
    mass = length + 1 + sum(w - 1 for w in weights)
    weights = (weights + [1.0] * (length + 1))[: length + 1]
    order = Window.partitionBy(*PIXEL).orderBy("frame_idx")
    before = F.collect_list("v").over(order.rowsBetween(-length, -1))  # oldest first
    seen = px.withColumn("before", before)
    own = F.array(*[F.lit(w) for w in weights[1:]])
    total = F.aggregate(F.zip_with("before", F.slice(own, 1, F.size("before")), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    v = F.when(F.size("before") == 0, F.col("v")).otherwise(F.floor((F.col("v") * weights[0] + total) / mass).cast("int"))
    return seen.select(*FRAME, "y", "x", v.alias("v"))


def motion_history(motion: DataFrame, length: int) -> DataFrame:
    """Whole mean of a motion frame and up to `length` before it, over as many as there are."""
    order = Window.partitionBy(*PIXEL).orderBy("frame_idx").rowsBetween(-length, 0)
    return motion.select(*FRAME, "y", "x", F.floor(F.sum("v").over(order) / F.count("v").over(order)).cast("int").alias("v"))


def denoise(px: DataFrame, radius: int, most: float) -> DataFrame:
    """Mean over frames within radius if it's within `most` of the pixel, else the pixel."""
    around = Window.partitionBy(*PIXEL).orderBy("frame_idx").rowsBetween(-radius, radius)
    mean = F.floor(F.avg("v").over(around)).cast("int")
    return px.select(*FRAME, "y", "x", F.when(F.abs(mean - F.col("v")) < most, mean).otherwise(F.col("v")).alias("v"))


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per frame, of two versions of a clip; null where they are equal."""
    both = a.join(b.withColumnRenamed("v", "w"), [*FRAME, "y", "x"])
    mse = F.avg(F.pow(F.col("v") - F.col("w"), 2))
    return both.groupBy(*FRAME).agg(F.when(mse > 0, 10 * F.log10(255.0 * 255.0 / mse)).alias("psnr"))


def ssim(a: DataFrame, b: DataFrame, width: int, height: int, size: int = 8, step: int = 4) -> DataFrame:
    """Structural similarity of two versions of a clip: per frame the mean over blocks of size x size at every step."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    both = a.join(b.withColumnRenamed("v", "w"), [*FRAME, "y", "x"])
    for axis, most in (("y", (height - size) // step), ("x", (width - size) // step)):
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(axis) - size + 1) / step))
        last = F.least(F.lit(most).cast("long"), F.floor(F.col(axis) / step))
        both = both.where(first <= last).withColumn(f"b{axis}", F.explode(F.sequence(first, last)))
    m, n = F.avg("v"), F.avg("w")
    vv, ww, vw = F.avg(F.col("v") * F.col("v")) - m * m, F.avg(F.col("w") * F.col("w")) - n * n, F.avg(F.col("v") * F.col("w")) - m * n
    blocks = both.groupBy(*FRAME, "by", "bx").agg(((2 * m * n + c1) * (2 * vw + c2) / ((m * m + n * n + c1) * (vv + ww + c2))).alias("s"))
    return blocks.groupBy(*FRAME).agg(F.avg("s").alias("ssim"))


def mask_boxes(px: DataFrame, boxes: DataFrame, fill: int = 0, ellipse: bool = False, scale: float = 1.0) -> DataFrame:
    """Pixels inside any box (x1, y1, x2, y2) of their frame become fill; boxes grow about their centres by scale.

    With ellipse only what lies inside a box's ellipse is filled. A frame's boxes are
    one array, so pixels are joined by frame and stay one row each.
    """
    own = boxes.groupBy(*FRAME).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))

    def holds(b: Column) -> Column:
        dx, dy = F.abs(F.col("x") - (b["x1"] + b["x2"]) / 2), F.abs(F.col("y") - (b["y1"] + b["y2"]) / 2)
        rx, ry = (b["x2"] - b["x1"]) * scale / 2, (b["y2"] - b["y1"]) * scale / 2
        return dx * dx * ry * ry + dy * dy * rx * rx <= rx * rx * ry * ry if ellipse else (dx <= rx) & (dy <= ry)

    inside = F.coalesce(F.exists("boxes", holds), F.lit(False))
    return px.join(own, FRAME, "left").select(*FRAME, "y", "x", F.when(inside, fill).otherwise(F.col("v")).alias("v"))


def equirect_to_flat(px: DataFrame, width: int, height: int, out_width: int, out_height: int, fov: float = 90.0, yaw: float = 0.0) -> DataFrame:
    """A flat view of a full-sphere clip: degrees across and to the side, the nearest source pixel of each place.

    The map of places is as large as an output frame, whatever the number of frames.
    """
    import math

    reach = math.tan(math.radians(fov) / 2)
    across, down = ((F.col(a) + 0.5) * 2 / n - 1 for a, n in (("x", out_width), ("y", out_height)))
    a, b = across * reach, down * reach * out_height / out_width
    east, south = F.atan2(a, F.lit(1.0)) + math.radians(yaw), F.atan2(b, F.sqrt(a * a + 1))
    places = px.sparkSession.range(out_width * out_height).select((F.col("id") % out_width).cast("int").alias("x"), F.floor(F.col("id") / out_width).cast("int").alias("y"))
    sx = F.pmod(F.floor((east / (2 * math.pi) + 0.5) * width), F.lit(width)).cast("int")
    sy = F.least(F.floor((south / math.pi + 0.5) * height), F.lit(height - 1)).cast("int")
    places = places.select("x", "y", sx.alias("sx"), sy.alias("sy"))
    source = px.select(*FRAME, F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return source.join(places, ["sy", "sx"]).select(*FRAME, "y", "x", "v")


def motion_score(px: DataFrame, k: int) -> DataFrame:
    """Mean absolute change of blurred frames per clip."""
    return difference(box_blur(px, k)).groupBy("media_id").agg(F.avg("v").alias("score"))


def gradient_flow(px: DataFrame) -> DataFrame:
    """(fx, fy) per pixel: normal flow from central differences, 0 where there's no gradient or at the border."""
    across, down = (Window.partitionBy(*FRAME, a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    time = Window.partitionBy(*PIXEL).orderBy("frame_idx")
    g = by_frame(px).select("*", ((F.lead("v").over(across) - F.lag("v").over(across)) / 2).alias("ix"), ((F.lead("v").over(down) - F.lag("v").over(down)) / 2).alias("iy"), (F.lead("v").over(time) - F.col("v")).alias("it"))
    size = F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy")
    part = lambda c: F.when(size > 0, -F.col("it") * F.col(c) / size).otherwise(0.0) + 0.0
    return g.where(F.col("it").isNotNull()).select(*FRAME, "y", "x", part("ix").alias("fx"), part("iy").alias("fy"))


def window_flow(px: DataFrame, k: int) -> DataFrame:
    """(fx, fy) per pixel by least squares over the gradients in k x k around it; 0 where these leave it open."""
    across, down = (Window.partitionBy(*FRAME, a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    time = Window.partitionBy(*PIXEL).orderBy("frame_idx")
    slope = lambda w: F.coalesce((F.lead("v").over(w) - F.lag("v").over(w)) / 2, F.lit(0.0))
    g = by_frame(px).select(*FRAME, "y", "x", slope(across).alias("ix"), slope(down).alias("iy"), (F.lead("v").over(time) - F.col("v")).alias("it")).where("it IS NOT NULL")
    names = [("ix", "ix"), ("ix", "iy"), ("iy", "iy"), ("ix", "it"), ("iy", "it")]
    sums = box_sums(g, k, **{a[1:] + b[1:]: F.col(a) * F.col(b) for a, b in names})
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solved = lambda a, b, c: F.when(det > 1e-6, (F.col("xy") * F.col(c) - F.col(a) * F.col(b)) / det).otherwise(0.0) + 0.0
    return sums.select(*FRAME, "y", "x", solved("yy", "xt", "yt").alias("fx"), solved("xx", "yt", "xt").alias("fy"))


def motion_area(px: DataFrame, k: int, c: int, width: int, height: int) -> DataFrame:
    """Per frame the box of the largest connected area that differs from its neighbourhood's mean, as shares of the frame.

    A pixel is in an area if it's not over the mean of k x k around it less c; areas join
    in eight directions; the largest has most pixels, of equals the topmost, then the
    leftmost; without any the box is 0. Labels spread within one frame's array.
    """
    import numpy as np
    import pandas as pd

    def largest(frame: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros((height + 2, width + 2), bool)
        on[frame["y"].to_numpy() + 1, frame["x"].to_numpy() + 1] = frame["v"].to_numpy() == 0
        label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
        while True:
            least = label.copy()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    least[1:-1, 1:-1] = np.minimum(least[1:-1, 1:-1], label[1 + dy : height + 1 + dy, 1 + dx : width + 1 + dx])
            least[~on] = on.size
            if (least == label).all():
                break
            label = least
        box = [0.0] * 4
        if on.any():
            names, counts = np.unique(label[on], return_counts=True)
            ys, xs = np.nonzero(label == names[counts.argmax()])
            box = [(xs.min() - 1) / width, (ys.min() - 1) / height, xs.max() / width, ys.max() / height]
        return pd.DataFrame([[*frame[FRAME].iloc[0], *box]], columns=[*FRAME, "AomX1", "AomY1", "AomX2", "AomY2"])

    schema = ", ".join([f"{c} {px.schema[c].dataType.simpleString()}" for c in FRAME] + [f"{c} double" for c in ("AomX1", "AomY1", "AomX2", "AomY2")])
    return adaptive_mean(px, k, c).groupBy(*FRAME).applyInPandas(largest, schema)


def directogram(flow: DataFrame, bins: int = 100) -> DataFrame:
    """Flow length summed by direction: bins 1..bins-1 between even edges over [-pi, pi]; only bins that occur."""
    import math

    edges = F.array(*[F.lit(-math.pi + k * 2 * math.pi / (bins - 1)) for k in range(bins - 1)])
    angle, length = F.atan2(F.col("fy"), F.col("fx")), F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    moved = flow.where((F.col("fx") != 0) | (F.col("fy") != 0)).select(*FRAME, angle.alias("angle"), length.alias("length"))
    found = F.size(F.filter(edges, lambda e: e <= F.col("angle")))
    return moved.groupBy(*FRAME, found.alias("bin")).agg(F.sum("length").alias("mag"))


def flow_velocity(flow: DataFrame, timestep: float = 1.0, move_step: int = 1) -> DataFrame:
    """Summed flow per frame over the pixels at every move_step and the time of a step."""
    each = F.count("*") / float(move_step**2) * timestep
    return flow.groupBy(*FRAME).agg((F.sum("fx") / each).alias("vx"), (F.sum("fy") / each).alias("vy"))


def flow_acceleration(velocity: DataFrame, fps: float) -> DataFrame:
    """Per clip the mean of |v[i+1]| * fps over all frames but the last, and the entropy of its shares."""
    speed = velocity.select(*FRAME, F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("v"))
    a = speed.select("media_id", (F.lead("v").over(Window.partitionBy("media_id").orderBy("frame_idx")) * fps).alias("a")).where("a IS NOT NULL")
    total = a.groupBy("media_id").agg(F.sum("a").alias("total"))
    p = F.when((F.col("total") > 0) & (F.col("a") > 0), F.col("a") / F.col("total"))
    return a.join(total, "media_id").groupBy("media_id").agg(F.avg("a").alias("mean"), F.sum(F.coalesce(-p * F.ln(p), F.lit(0.0))).alias("entropy"))
