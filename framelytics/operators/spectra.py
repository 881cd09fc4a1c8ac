"""Band, pitch and tempo operators on spectra (media_id, frame_idx, k, mag) and long series.

Windows over time go by blocks with a margin, so a long clip is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096
#: Fixed values of the mel scale: even up to 1000 Hz at 200/3 Hz a mel, then 27 mels for each factor of 6.4.
HZ_A_MEL, BREAK_HZ, BREAK_MEL, LOG_STEP = 200 / 3, 1000.0, 15.0, math.log(6.4) / 27


def in_blocks(df: DataFrame, keys: list[str], at: str, before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, WindowSpec, Column]:
    """df with a column _b, a window over `at` within it, and which rows to keep once the window is used.

    `at` counts 0, 1, ... per key. A row goes to its own block and as a margin to those
    whose windows reach it, so that a task holds block + before + after rows of a key.
    """
    at_ = F.col(at)
    spread = df.withColumn("_b", F.explode(F.sequence(F.floor((at_ - after) / block), F.floor((at_ + before) / block))))
    return spread, Window.partitionBy(*keys, "_b").orderBy(at), F.col("_b") == F.floor(at_ / block)


def hz_to_mel(hz: float) -> float:
    return hz / HZ_A_MEL if hz < BREAK_HZ else BREAK_MEL + math.log(hz / BREAK_HZ) / LOG_STEP


def mel_to_hz(mel: float) -> float:
    return mel * HZ_A_MEL if mel < BREAK_MEL else BREAK_HZ * math.exp((mel - BREAK_MEL) * LOG_STEP)


def mel_filters(sr: float, size: int, bands: int) -> list[tuple[int, int, float]]:
    """(k, band, weight): triangles of equal area, even in mel from 0 to sr / 2; a band without bins has weight 0 at bin 0."""
    top = hz_to_mel(sr / 2)
    edge = [mel_to_hz(i * top / (bands + 1)) for i in range(bands + 2)]
    out = []
    for m, (a, b, c) in enumerate(zip(edge, edge[1:], edge[2:])):
        found = [(k, m, min((k * sr / size - a) / (b - a), (c - k * sr / size) / (c - b)) * 2 / (c - a)) for k in range(size // 2 + 1)]
        out += [x for x in found if x[2] > 0] or [(0, m, 0.0)]
    return out


def mel_power(spec: DataFrame, sr: float, size: int, bands: int) -> DataFrame:
    """(media_id, frame_idx, band, power): each bin's power summed by a literal table of at most two bands a bin."""
    filters = spec.sparkSession.createDataFrame(mel_filters(sr, size, bands), "k int, band int, w double")
    weighed = spec.join(F.broadcast(filters), "k")  # 2 * size rows at most
    return weighed.groupBy("media_id", "frame_idx", "band").agg(F.sum(F.col("w") * F.col("mag") * F.col("mag")).alias("power"))


def chroma(spec: DataFrame, sr: float, size: int) -> DataFrame:
    """Energy of each pitch class that occurs (0 is C, by the nearest semitone of A = 440 Hz) over the frame's greatest; silence is 0."""
    semitone = F.round(69 + 12 * F.log2(F.col("k") * (sr / size) / 440.0)).cast("int")
    pitched = spec.where("k > 0").groupBy("media_id", "frame_idx", F.pmod(semitone, F.lit(12)).alias("pitch")).agg(F.sum(F.col("mag") * F.col("mag")).alias("e"))
    most = F.max("e").over(Window.partitionBy("media_id", "frame_idx"))
    return pitched.select("media_id", "frame_idx", "pitch", F.when(most > 0, F.col("e") / most).otherwise(0.0).alias("chroma"))


def harmonic_percussive(spec: DataFrame, kernel: int = 31, margin: tuple[float, float] = (1.0, 5.0), power: float = 2.0) -> DataFrame:
    """harmonic, percussive and residual parts of mag by soft masks of medians along time and along bins.

    A median at an edge takes the values that exist; where both medians are 0 the parts are 0.
    """
    r = kernel // 2
    blocks, time, own = in_blocks(spec, ["media_id", "k"], "frame_idx", r, r)
    middle = F.expr("percentile(mag, 0.5)")
    h = blocks.withColumn("h", middle.over(time.rowsBetween(-r, r))).where(own).drop("_b")
    both = h.withColumn("p", middle.over(Window.partitionBy("media_id", "frame_idx").orderBy("k").rowsBetween(-r, r)))

    def part(this: str, other: str, by: float) -> Column:
        a, b = F.pow(this, power), F.pow(F.col(other) * by, power)
        return F.when(a + b > 0, F.col("mag") * a / (a + b)).otherwise(0.0)

    both = both.withColumns({"harmonic": part("h", "p", margin[0]), "percussive": part("p", "h", margin[1])})
    return both.select("media_id", "frame_idx", "k", "harmonic", "percussive", (F.col("mag") - F.col("harmonic") - F.col("percussive")).alias("residual"))


def tempogram(onsets: DataFrame, win: int) -> DataFrame:
    """(media_id, frame_idx, lag, r): autocorrelation of `onset` within win frames on each side under a Hann window, over that of lag 0.

    Frames beyond the clip's ends count as 0, and so does a window of silence.
    """
    size = 2 * win + 1
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (size + 1)) for i in range(size)]
    blocks, order, own = in_blocks(onsets, ["media_id"], "frame_idx", win, win)
    near = F.array(*[F.coalesce((F.lag("onset", win - i) if i <= win else F.lead("onset", i - win)).over(order), F.lit(0.0)) * hann[i] for i in range(size)])
    seen = blocks.select("*", near.alias("near")).where(own)
    dots = F.transform(F.sequence(F.lit(0), F.lit(win)), lambda lag: F.aggregate(F.zip_with(F.slice("near", 1, size - lag), F.slice("near", lag + 1, size - lag), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    lags = seen.select("media_id", "frame_idx", dots.alias("dots")).select("media_id", "frame_idx", F.get("dots", F.lit(0)).alias("whole"), F.posexplode("dots").alias("lag", "dot"))
    return lags.select("media_id", "frame_idx", "lag", F.when(F.col("whole") > 0, F.col("dot") / F.col("whole")).otherwise(0.0).alias("r"))


def tempo(tempograms: DataFrame, frames_a_second: float, start_bpm: float = 120.0, octaves: float = 1.0) -> DataFrame:
    """Beats a minute of each clip: the lag with the greatest mean, weighed by its distance in octaves from start_bpm."""
    mean = tempograms.where("lag > 0").groupBy("media_id", "lag").agg(F.avg("r").alias("r"))
    bpm = 60.0 * frames_a_second / F.col("lag")
    score = F.ln(1 + 1e6 * F.greatest("r", F.lit(0.0))) - 0.5 * F.pow((F.log2(bpm) - math.log2(start_bpm)) / octaves, 2)
    return mean.groupBy("media_id").agg(F.max_by(bpm, score).alias("bpm"))


def dilate(s: DataFrame, ratio: float) -> DataFrame:
    """The series at ratio times its speed: output t is sample floor(t * ratio), found without a join."""
    first, after = F.ceil(F.col("n") / ratio), F.ceil((F.col("n") + 1) / ratio)
    return s.where(first < after).select("media_id", "n", F.explode(F.sequence(first, after - 1).cast("array<int>")).alias("t"), "y")
