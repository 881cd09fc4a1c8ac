"""Feature sequences of clips, their similarity, descriptors in physical units, and pose tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import normalised, self_similarity
from .spectra import in_blocks

FRAME = ["media_id", "frame_idx"]


def vectors(rows: DataFrame, at: str, value: str) -> DataFrame:
    """(media_id, frame_idx, vec) of rows with one value for each place `at` of a frame."""
    own = rows.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.col(value).cast("double").alias("v")))).alias("own"))
    return own.select(*FRAME, F.transform("own", lambda x: x["v"]).alias("vec"))


def smoothed(rows: DataFrame, at: str, value: str, length: int = 41, step: int = 10) -> DataFrame:
    """Each place's values as boxcar means over `length` frames (missing ones are 0), of every step-th frame."""
    r = length // 2
    blocks, order, own = in_blocks(rows, ["media_id", at], "frame_idx", r, r)
    total = F.sum(value).over(order.rangeBetween(-r, r)) / length
    kept = blocks.select(*FRAME, at, "_b", total.alias(value)).where(own & (F.col("frame_idx") % step == 0))
    return kept.select("media_id", F.floor(F.col("frame_idx") / step).cast("int").alias("frame_idx"), at, value)


def similarity(rows: DataFrame, at: str, value: str, norm: float = math.inf, threshold: float = 1e-3, smooth: bool = False, axis: str = "time") -> DataFrame:
    """Self-similarity (media_id, i, j, s) of a feature: smoothed if asked for, each frame divided by its norm, then dot products.

    With axis "space" the places are compared over all frames instead of the frames over all places.
    """
    rows = smoothed(rows, at, value) if smooth else rows
    if axis == "space":
        rows = rows.select("media_id", F.col(at).alias("frame_idx"), F.col("frame_idx").alias("_at"), F.col(value))
        at = "_at"
    return self_similarity(normalised(vectors(rows, at, value), norm, threshold))


def descriptors(spec: DataFrame, waves: DataFrame, sr: float, size: int) -> DataFrame:
    """Per frame: centroid, bandwidth and both roll-offs in Hz, flatness and the root mean square of its samples. waves: (media_id, frame_idx, vec)."""
    hz, power = F.col("k") * (sr / size), F.col("mag") * F.col("mag")
    whole = spec.groupBy(*FRAME).agg(F.sum("mag").alias("total"), (F.sum(hz * F.col("mag")) / F.sum("mag")).alias("centroid"), (F.exp(F.avg(F.ln(F.greatest(F.lit(1e-10), power)))) / F.avg(F.greatest(F.lit(1e-10), power))).alias("flatness"))
    run = F.sum("mag").over(Window.partitionBy(*FRAME).orderBy("k"))
    both = spec.withColumn("run", run).join(whole, FRAME)
    roll = lambda share: F.min(F.when(F.col("run") >= share * F.col("total"), hz))
    found = both.groupBy(*FRAME).agg(F.first("centroid").alias("centroid"), F.sqrt(F.sum(F.col("mag") / F.col("total") * F.pow(hz - F.col("centroid"), 2))).alias("bandwidth"), F.first("flatness").alias("flatness"), roll(0.99).alias("rolloff"), roll(0.01).alias("rolloff_min"))
    rms = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) / F.size("vec"))
    return found.join(waves.select(*FRAME, rms.alias("rms")), FRAME)


def coloured_waveform(spec: DataFrame, waves: DataFrame, sr: float, size: int, low: float, high: float) -> DataFrame:
    """Per column, a frame: its peaks in the order in which they come, and the log position of its centroid between two frequencies, 0 to 1."""
    centroid = spec.groupBy(*FRAME).agg((F.sum(F.col("k") * (sr / size) * F.col("mag")) / F.sum("mag")).alias("hz"))
    lo, hi = F.array_min("vec"), F.array_max("vec")
    early = F.array_position("vec", lo) <= F.array_position("vec", hi)
    peaks = waves.select(*FRAME, F.when(early, lo).otherwise(hi).alias("first"), F.when(early, hi).otherwise(lo).alias("second"))
    at = (F.log10(F.least(F.greatest(F.coalesce("hz", F.lit(low)), F.lit(low)), F.lit(high))) - math.log10(low)) / (math.log10(high) - math.log10(low))
    return peaks.join(centroid, FRAME).select(*FRAME, "first", "second", at.alias("centroid"), F.floor(at * 255).cast("int").alias("colour"))


def padded_blocks(s: DataFrame, size: int, hop: int) -> DataFrame:
    """(media_id, block, vec): `size` samples from block * hop - size / 2 on, of every block that begins within the series; places beyond its ends are 0."""
    half = size // 2
    low, high = F.ceil((F.col("n") + half - size + 1) / hop), F.floor((F.col("n") + half) / hop)
    last = s.groupBy("media_id").agg(F.max("n").alias("last"))
    spread = s.select("media_id", "n", "y", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("block")).join(last, "media_id").where(F.col("block") * hop <= F.col("last"))
    own = spread.groupBy("media_id", "block").agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") - F.col("block") * hop + half).cast("int").alias("i"), "y"))).alias("m"))
    return own.select("media_id", F.col("block").cast("int").alias("block"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def pose_table(points: DataFrame, parts: dict[int, str], fps: float) -> DataFrame:
    """A row per frame: Time in milliseconds and each part's X and Y, null where it wasn't found. parts: number -> name."""
    wide = points.groupBy(*FRAME).pivot("part", list(parts)).agg(F.first("px").alias("X"), F.first("py").alias("Y"))
    return wide.select(*FRAME, F.rint(F.col("frame_idx") / fps * 1000).cast("long").alias("Time"), *[F.col(f"`{k}_{a}`").alias(f"{name} {a}") for k, name in parts.items() for a in "XY"])


#: Words in names of parts by what they allow to measure; every group has to occur.
FAMILIES = {
    "body_center": (("hip",),),
    "shoulder_elbow_extension": (("shoulder",), ("elbow",)),
    "elbow_wrist_extension": (("elbow",), ("wrist",)),
    "hip_knee_extension": (("hip",), ("knee",)),
    "knee_ankle_extension": (("knee",), ("ankle",)),
    "upper_lower_comparison": (("nose", "eye", "ear", "shoulder", "elbow", "wrist"), ("hip", "knee", "ankle")),
    "symmetry_analysis": (("left",), ("right",)),
    "gesture_tracking": (("wrist", "hand", "finger"),),
}


def pose_families(parts: DataFrame) -> DataFrame:
    """Per model, which features its part names allow. parts: (model, name)."""
    has = lambda words: F.max(F.lower("name").rlike("|".join(words)))
    def every(groups):
        out = None
        for words in groups:
            out = has(words) if out is None else out & has(words)
        return out

    return parts.groupBy("model").agg(*[every(groups).alias(name) for name, groups in FAMILIES.items()])


def heatmap_peaks(maps: DataFrame, width: int, height: int, least: float) -> DataFrame:
    """(media_id, frame_idx, x, y, p): the greatest place of each two-dimensional map, as shares of its sides; null at or under `least`. Of equals the topmost, then the leftmost."""
    best = F.max_by(F.struct("y", "x", "v"), F.struct("v", -F.col("y"), -F.col("x"))).alias("b")
    found = maps.groupBy(*FRAME).agg(best)
    some = F.col("b.v") > least
    return found.select(*FRAME, F.when(some, F.col("b.x") / width).alias("x"), F.when(some, F.col("b.y") / height).alias("y"), F.col("b.v").alias("p"))


def clip_stats(px: DataFrame, fps: float, width: int) -> DataFrame:
    """Per clip: frames, duration in seconds and as text, and the rows of a pixel array of this width."""
    from ..functions.scalars import duration_string

    n = px.groupBy("media_id").agg((F.max("frame_idx") + 1).alias("frames"))
    return n.select("media_id", "frames", F.floor(F.col("frames") / fps).cast("int").alias("seconds"), duration_string(F.col("frames") / fps).alias("duration"), F.lit(int(fps + 0.5)).alias("fps"), F.ceil(F.col("frames") / width).cast("int").alias("rows"))


def synchronised(steps: DataFrame, speed: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(media_id, k, audio, visual): beats of sound and picture brought together: the running seconds of both at each common beat.

    steps: (media_id, kind, k, step) with kind `audio` or `visual` and steps in seconds. A
    picture step that is too short for the sound is passed over; a sound step that is too
    short grows by the next one, round and round; the last pair only ends the loop. Each
    decision needs the one before, so a clip's beats are one task, and clips are spread.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        sound, picture = (rows.loc[rows["kind"] == kind, "step"].to_numpy(float) for kind in ("audio", "visual"))
        pairs, a, v = [], 0, 0
        if len(sound) and len(picture) and sound.sum() > 0:
            long = sound[0]
            while v < len(picture):
                if picture[v] < speed[0] * long:
                    v += 1
                elif picture[v] > speed[1] * long:
                    a += 1
                    long += sound[a % len(sound)]
                else:
                    pairs.append((long, picture[v]))
                    a, v = a + 1, v + 1
                    long = sound[a % len(sound)]
        found = np.cumsum(np.array(pairs[:-1]).reshape(-1, 2), axis=0)
        return pd.DataFrame({"media_id": rows["media_id"].iloc[0], "k": np.arange(len(found)), "audio": found[:, 0], "visual": found[:, 1]})

    kind = steps.schema["media_id"].dataType.simpleString()
    return steps.groupBy("media_id").applyInPandas(meet, f"media_id {kind}, k int, audio double, visual double")


def warp_frames(met: DataFrame, fps: float) -> DataFrame:
    """(media_id, t, n): which frame n of the picture is shown at frame t of the sound's time, straight between common beats."""
    order = Window.partitionBy("media_id").orderBy("k")
    a0, v0 = F.coalesce(F.lag("audio").over(order), F.lit(0.0)), F.coalesce(F.lag("visual").over(order), F.lit(0.0))
    parts = met.select("media_id", "audio", "visual", a0.alias("a0"), v0.alias("v0")).where("audio > a0")
    shown = parts.select("*", F.explode(F.expr(f"sequence(cast(ceil(a0 * {fps}) as int), cast(greatest(ceil(a0 * {fps}), floor(audio * {fps})) as int))")).alias("t")).where(F.col("t") <= F.col("audio") * fps)
    slope = (F.col("visual") - F.col("v0")) / (F.col("audio") - F.col("a0"))
    return shown.select("media_id", "t", F.rint(((F.col("t") / fps - F.col("a0")) * slope + F.col("v0")) * fps).cast("int").alias("n"))


def beats(onsets: DataFrame, fps: float, bpm: float, tightness: float = 100.0) -> DataFrame:
    """(media_id, n): frames of beats by dynamic programming: strong onsets at even steps near the tempo bpm.

    onsets: (media_id, n, y). Onsets are divided by their deviation and smoothed over a beat;
    each frame's score is its onset and the best earlier one at half to twice a beat, less
    tightness times the squared log of the step over a beat; the last beat is the last peak
    of half the median peak's score, and others are found back from it. The search goes
    through a clip in order, so a clip is one task, and clips are spread.
    """

    def track(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("n")["y"].to_numpy(float)
        period = max(1, round(60.0 * fps / bpm))
        spread = y.std(ddof=1) if len(y) > 1 else 0
        found: list[int] = []
        if spread > 0:
            at = np.arange(-period, period + 1)
            local = np.convolve(y / spread, np.exp(-0.5 * (at * 32.0 / period) ** 2), "same")[: len(y)] if len(at) <= len(y) else y / spread
            steps = np.arange(-2 * period, -max(1, round(period / 2)) + 1)
            cost = -tightness * np.log(-steps / period) ** 2
            back, score, first = np.full(len(y), -1), np.zeros(len(y)), True
            for i in range(len(y)):
                past = i + steps
                options = np.where(past >= 0, cost + score[np.maximum(past, 0)], cost)
                best = int(options.argmax())
                score[i] = local[i] + options[best]
                if first and local[i] < 0.01 * local.max():
                    back[i] = -1
                else:
                    back[i], first = past[best], False
            peaks = np.flatnonzero((score >= np.r_[score[:1] - 1, score[:-1]]) & (score > np.r_[score[1:], score[-1:] - 1]))
            strong = peaks[score[peaks] * 2 > np.median(score[peaks])] if len(peaks) else peaks
            k = int(strong[-1]) if len(strong) else int(score.argmax())
            while k >= 0:
                found.append(k)
                k = int(back[k])
        return pd.DataFrame({"media_id": [rows["media_id"].iloc[0]] * len(found), "n": found[::-1]})

    kind = onsets.schema["media_id"].dataType.simpleString()
    return onsets.select("media_id", "n", "y").groupBy("media_id").applyInPandas(track, f"media_id {kind}, n int")


def frames_from_arrays(spark, clips: dict[int, np.ndarray]) -> DataFrame:
    """Pixel rows of arrays of (frames, height, width) or (frames, height, width, channels) levels; small clips that the caller holds already."""
    parts = []
    for media_id, a in clips.items():
        a = a[..., None] if a.ndim == 3 else a
        t, y, x, c = (i.ravel() for i in np.indices(a.shape))
        parts.append(pd.DataFrame({"media_id": media_id, "frame_idx": t, "y": y, "x": x, "c": c, "v": a.ravel()}).astype("int32"))
    return spark.createDataFrame(pd.concat(parts), "media_id int, frame_idx int, y int, x int, c int, v int")


def frame_table(px: DataFrame, width: int, height: int) -> DataFrame:
    """(media_id, frame_idx, h, w, ch, data): a row per frame, its levels as bytes in the order of y, x, c. For writing as a table."""
    own = px if "c" in px.columns else px.withColumn("c", F.lit(0))
    cells = own.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("y", "x", "c", "v"))).alias("cells"), (F.max("c") + 1).alias("ch"))
    data = F.unhex(F.array_join(F.transform("cells", lambda x: F.lpad(F.hex(x["v"].cast("long")), 2, "0")), ""))
    return cells.select(*FRAME, F.lit(height).alias("h"), F.lit(width).alias("w"), "ch", data.alias("data"))


def pixels_of(frames: DataFrame) -> DataFrame:
    """The pixel rows of a frame table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.ch)
                y, x, c = (i.ravel() for i in np.indices(a.shape))
                yield pd.DataFrame({"media_id": r.media_id, "frame_idx": r.frame_idx, "y": y, "x": x, "c": c, "v": a.ravel().astype("int32")})

    kind = frames.schema["media_id"].dataType.simpleString()
    return frames.mapInPandas(read, f"media_id {kind}, frame_idx int, y int, x int, c int, v int")
