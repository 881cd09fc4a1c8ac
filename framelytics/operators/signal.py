"""Spectra of real samples: framing, Fourier transforms and back, masks, bands and descriptors.

samples: (media_id, n, y), n from 0, a value each; spectra: (media_id, frame_idx, re, im), a row
a frame with arrays over the bins 0 to n_fft / 2. Long clips go by blocks with a margin, so that
a clip is spread over tasks and a task holds a block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectra import mel_filters

#: Frames of a block.
BLOCK = 256
FRAME = ["media_id", "frame_idx"]


def hann(n_fft: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)


def _arrays(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    flat = np.ascontiguousarray(values, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, which have one length, as rows."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _repeated(key: tuple, types: list[pa.DataType], n: int) -> list[pa.Array]:
    return [pa.array([k.as_py()] * n, t) for k, t in zip(key, types, strict=True)]


def stft(samples: DataFrame, n_fft: int = 2048, hop: int = 512, block: int = BLOCK) -> DataFrame:
    """(media_id, frame_idx, re, im): transforms under a Hann window of frames centred at every hop-th sample.

    Zeros lie beyond both ends; a clip of so many samples has 1 + samples // hop frames. A
    sample goes to the block of frames that hold it, and as a margin to the next ones.
    n_fft is even. Missing and null samples are 0, a clip without samples has no frames.
    """
    half = n_fft // 2
    first, last = F.ceil((F.col("n") - half + 1) / hop), F.floor((F.col("n") + half) / hop)
    near = samples.select("media_id", "n", "y", F.explode(F.sequence(F.greatest(F.floor(first / block), F.lit(0)), F.floor(last / block))).alias("b"))

    def transform(key: tuple, rows: pa.Table) -> pa.Table:
        n, y = rows.column("n").to_numpy().astype(np.int64), rows.column("y").fill_null(0.0).to_numpy()
        at = key[1].as_py() * block
        frames = min(block, int(n.max() + 1) // hop + 1 - at)
        if frames <= 0:
            return pa.Table.from_arrays([pa.array([], t) for t in (types[0], pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))], names=[*FRAME, "re", "im"])
        wave = np.zeros((frames - 1) * hop + n_fft)
        place = n - at * hop + half
        here = (place >= 0) & (place < len(wave))
        wave[place[here]] = y[here]
        found = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wave, n_fft)[::hop] * hann(n_fft), axis=1)
        return pa.Table.from_arrays([*_repeated(key[:1], types, frames), pa.array(np.arange(at, at + frames, dtype=np.int32)), _arrays(found.real), _arrays(found.imag)], names=[*FRAME, "re", "im"])

    types = [_arrow(samples, "media_id")]
    return near.groupBy("media_id", "b").applyInArrow(transform, f"{_kinds(samples, ['media_id'])}, frame_idx int, re array<double>, im array<double>")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def istft(spectra: DataFrame, n_fft: int = 2048, hop: int = 512, keys: list[str] | None = None, block: int = BLOCK, tail: bool = False) -> DataFrame:
    """(keys, n, y): samples by windowed overlap-add of the frames' inverse transforms, over the summed squares of the window.

    keys name a clip, media_id by default. A frame goes to each block of samples that it
    reaches, so a task adds up whole samples. They end at the last frame's centre, or with
    `tail` where its window ends; where no window reaches the sum is 0.
    """
    keys, half = keys or ["media_id"], n_fft // 2
    size = block * hop
    first, last = F.floor((F.col("frame_idx") * hop - half) / size), F.floor((F.col("frame_idx") * hop + half - 1) / size)
    near = spectra.select(*keys, "frame_idx", "re", "im", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("b"))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        t, window, at = rows.column("frame_idx").to_numpy().astype(np.int64), hann(n_fft), key[-1].as_py() * size
        waves = np.fft.irfft(_matrix(rows.column("re")) + 1j * _matrix(rows.column("im")), n_fft, axis=1) * window
        y, weight = np.zeros(size + 2 * n_fft), np.zeros(size + 2 * n_fft)
        for k, begin in enumerate((t * hop - half - at + n_fft).tolist()):
            y[begin : begin + n_fft] += waves[k]
            weight[begin : begin + n_fft] += window * window
        n = np.arange(at, at + max(0, min(size, int(t.max()) * hop + (half if tail else 0) - at)))
        y, weight = y[n_fft : n_fft + len(n)], weight[n_fft : n_fft + len(n)]
        y = np.divide(y, weight, out=np.zeros_like(y), where=weight > 1e-12)
        return pa.Table.from_arrays([*_repeated(key[:-1], types, len(n)), pa.array(n), pa.array(y)], names=[*keys, "n", "y"])

    types = [_arrow(spectra, k) for k in keys]
    return near.groupBy(*keys, "b").applyInArrow(add, f"{_kinds(spectra, keys)}, n long, y double")


def reflected(a: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """a with so many places on both sides that mirror its ends, the end itself first."""
    return np.pad(a, [(before, after) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric")


def soft_mask(a: np.ndarray, b: np.ndarray, power: float, even: bool) -> np.ndarray:
    """a ** power over the sum of both; where both are nearly 0, a half if `even`, else 0."""
    most = np.maximum(a, b)
    none = most < np.finfo(np.float32).tiny
    most = np.where(none, 1.0, most)
    x, y = (a / most) ** power, (b / most) ** power
    return np.where(none, 0.5 if even else 0.0, x / np.where(none, 1.0, x + y))


def separated(spectra: DataFrame, kernel: int = 31, margin: tuple[float, float] = (1.0, 1.0), power: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(media_id, part, frame_idx, re, im): the harmonic and the percussive part of each frame by soft masks.

    The masks come from medians of the magnitude over `kernel` frames and over `kernel` bins;
    clips and bins are mirrored at their ends. kernel is odd. With both margins 1 the parts sum to the whole.
    """
    r = kernel // 2
    near = spectra.select(*FRAME, "re", "im", F.explode(F.sequence(F.greatest(F.floor((F.col("frame_idx") - r) / block), F.lit(0)), F.floor((F.col("frame_idx") + r) / block))).alias("b"))

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        t, at = rows.column("frame_idx").to_numpy(), key[1].as_py() * block
        own = np.flatnonzero((t >= at) & (t < at + block))
        whole = _matrix(rows.column("re")) + 1j * _matrix(rows.column("im"))
        mag, whole = np.abs(whole), whole[own]
        if not len(own):
            own = np.zeros(0, np.int64)
            parts = [whole, whole]
        else:
            before, after = int(own[0]), int(len(t) - 1 - own[-1])
            wide = reflected(mag, r - before, r - after, 0)
            h = np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(wide[:, k : k + 64], kernel, axis=0), axis=-1) for k in range(0, mag.shape[1], 64)], axis=1)
            p = np.median(np.lib.stride_tricks.sliding_window_view(reflected(mag[own], r, r, 1), kernel, axis=1), axis=-1)
            even = margin == (1.0, 1.0)
            parts = [whole * soft_mask(h, p * margin[0], power, even), whole * soft_mask(p, h * margin[1], power, even)]
        both, n = np.concatenate(parts), len(own)
        names = pa.array(["harmonic"] * n + ["percussive"] * n, pa.string())
        return pa.Table.from_arrays([*_repeated(key[:1], types, 2 * n), names, pa.array(np.tile(t[own], 2).astype(np.int32)), _arrays(both.real), _arrays(both.imag)], names=["media_id", "part", "frame_idx", "re", "im"])

    types = [_arrow(spectra, "media_id")]
    return near.groupBy("media_id", "b").applyInArrow(split, f"{_kinds(spectra, ['media_id'])}, part string, frame_idx int, re array<double>, im array<double>")


def separated_wave(samples: DataFrame, n_fft: int = 2048, hop: int = 512, kernel: int = 31, margin: tuple[float, float] = (1.0, 1.0), power: float = 2.0) -> DataFrame:
    """(media_id, n, y, harmonic, percussive, residual) of each sample: the parts of its clip's spectra back as samples, and what they leave."""
    parts = istft(separated(stft(samples, n_fft, hop), kernel, margin, power), n_fft, hop, ["media_id", "part"], tail=True)
    both = samples.select("media_id", F.lit("y").alias("part"), F.col("n").cast("long").alias("n"), F.coalesce("y", F.lit(0.0)).alias("y")).unionByName(parts)
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("y")))
    found = both.groupBy("media_id", "n").agg(of("y").alias("y"), F.coalesce(of("harmonic"), F.lit(0.0)).alias("harmonic"), F.coalesce(of("percussive"), F.lit(0.0)).alias("percussive"))
    return found.where("y IS NOT NULL").withColumn("residual", F.col("y") - F.col("harmonic") - F.col("percussive"))


def magnitudes(spectra: DataFrame) -> DataFrame:
    """(media_id, frame_idx, mag): an array over the bins."""
    return spectra.select(*FRAME, F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)).alias("mag"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def descriptors(mags: DataFrame, sr: float, n_fft: int, rolls: tuple[float, float] = (0.99, 0.01)) -> DataFrame:
    """Per frame of (media_id, frame_idx, mag): centroid, bandwidth, flatness and both roll-offs, in Hz but for flatness.

    Arrays are summed where they are, without a row a bin. A silent frame has centroid,
    bandwidth and roll-offs 0 and flatness 1.
    """
    step, low = sr / n_fft, 1e-10
    mags = mags.withColumn("total", _total(F.col("mag")))
    moment = lambda f: F.aggregate("mag", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda s, x: F.struct((s["s"] + x * f(s["k"])).alias("s"), (s["k"] + 1).alias("k")), lambda s: s["s"])
    share = lambda v: F.when(F.col("total") > 0, v / F.col("total")).otherwise(0.0)
    found = mags.withColumn("centroid", share(moment(lambda k: k * step)))
    found = found.withColumn("bandwidth", F.sqrt(share(moment(lambda k: F.pow(k * step - F.col("centroid"), 2)))))
    power = F.transform("mag", lambda x: F.greatest(x * x, F.lit(low)))
    found = found.withColumn("flatness", F.exp(_total(F.transform(power, F.ln)) / F.size("mag")) / (_total(power) / F.size("mag")))

    def roll(part: float) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
        return F.aggregate("mag", start, lambda s, x: F.struct((s["s"] + x).alias("s"), (s["k"] + F.when(s["s"] + x < part * F.col("total"), 1).otherwise(0)).alias("k")), lambda s: s["k"] * step)

    return found.select(*FRAME, "centroid", "bandwidth", "flatness", roll(rolls[0]).alias("rolloff"), roll(rolls[1]).alias("rolloff_min"))


def banded(mags: DataFrame, filters: list[tuple[int, int, float]], n_fft: int, bands: int, name: str) -> DataFrame:
    """(media_id, frame_idx, name): an array over bands of the power weighed by filters (bin, band, weight).

    A product of each batch of frames with the matrix of weights, which has n_fft / 2 + 1 rows.
    """
    weights = np.zeros((n_fft // 2 + 1, bands))
    for k, band, w in filters:
        weights[k, band] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mag = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _arrays(mag * mag @ weights)], names=[*FRAME, name])

    return mags.select(*FRAME, "mag").mapInArrow(run, f"{_kinds(mags, FRAME)}, {name} array<double>")


def mel(mags: DataFrame, sr: float, n_fft: int, bands: int = 128) -> DataFrame:
    """(media_id, frame_idx, mel): power in triangles of equal area, even in mel from 0 to sr / 2."""
    return banded(mags, mel_filters(sr, n_fft, bands), n_fft, bands, "mel")


def chroma_filters(sr: float, n_fft: int, classes: int = 12, tuning: float = 0.0, centre: float = 5.0, width: float = 2.0) -> list[tuple[int, int, float]]:
    """(bin, pitch class, weight): each bin spread over the classes by a bell as wide as the bin, and weighed by how far its octave is from `centre`.

    Class 0 is C. tuning: the deviation from A = 440 Hz in parts of a class.
    """
    hz = np.arange(1, n_fft) * sr / n_fft
    place = classes * np.log2(hz / (440.0 * 2 ** (tuning / classes) / 16))
    place = np.concatenate([[place[0] - 1.5 * classes], place])  # bin 0 an octave and a half below the next
    wide = np.append(np.maximum(np.diff(place), 1.0), 1.0)
    away = np.remainder(place - np.arange(classes)[:, None] + 10.5 * classes, classes) - classes / 2
    bell = np.exp(-0.5 * (2 * away / wide) ** 2)
    bell /= np.sqrt((bell**2).sum(axis=0))
    bell *= np.exp(-0.5 * ((place / classes - centre) / width) ** 2)
    bell = np.roll(bell, -3 * (classes // 12), axis=0)[:, : n_fft // 2 + 1]
    return [(k, c, float(bell[c, k])) for c in range(classes) for k in range(bell.shape[1])]


def chroma(mags: DataFrame, sr: float, n_fft: int, tuning: float = 0.0) -> DataFrame:
    """(media_id, frame_idx, chroma): power spread over the twelve pitch classes, over the frame's greatest; silence is 0."""
    found = banded(mags, chroma_filters(sr, n_fft, tuning=tuning), n_fft, 12, "chroma").withColumn("_most", F.array_max("chroma"))
    return found.select(*FRAME, F.transform("chroma", lambda x: F.when(F.col("_most") > 1e-30, x / F.col("_most")).otherwise(0.0)).alias("chroma"))


def decibels(bands: DataFrame, name: str, top_db: float = 80.0) -> DataFrame:
    """name in dB of the clip's greatest value, not under -top_db."""
    most = bands.groupBy("media_id").agg(F.max(F.array_max(name)).alias("_most"))
    level = lambda x: F.greatest(10 * F.log10(F.greatest(x, F.lit(1e-10)) / F.greatest(F.col("_most"), F.lit(1e-10))), F.lit(-top_db))
    return bands.join(most, "media_id").select(*FRAME, F.transform(name, level).alias(name))


def onsets(levels: DataFrame, name: str, lag: int = 1) -> DataFrame:
    """(media_id, frame_idx, onset): the mean over bands of the rise in dB since the frame `lag` before; 0 where there is none.

    The frame before is found by its number, so a clip is no window.
    """
    before = levels.select("media_id", (F.col("frame_idx") + lag).alias("frame_idx"), F.col(name).alias("_before"))
    rise = _total(F.zip_with(name, "_before", lambda a, b: F.greatest(a - b, F.lit(0.0)))) / F.size(name)
    return levels.join(before, FRAME, "left").select(*FRAME, F.coalesce(F.when(F.col("_before").isNotNull(), rise), F.lit(0.0)).alias("onset"))
