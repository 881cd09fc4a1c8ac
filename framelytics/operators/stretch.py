"""Time stretch that keeps pitch, by waveform-similarity overlap-add.

W. Verhelst and M. Roelands, "An Overlap-Add Technique Based on Waveform Similarity (WSOLA)
for High Quality Time-Scale Modification of Speech" (1993).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import _arrow, _kinds, _repeated, hann


def best_shift(natural: np.ndarray, around: np.ndarray) -> int:
    """Where in `around` the segment most like `natural` starts: the greatest normalised correlation, of equals the nearest to the middle."""
    n, size = len(natural), len(around) - len(natural) + 1
    length = 1 << (len(around) + n - 1).bit_length()
    dots = np.fft.irfft(np.fft.rfft(around, length) * np.conj(np.fft.rfft(natural, length)), length)[:size]
    energy = np.concatenate([[0.0], np.cumsum(around * around)])
    score = dots / np.sqrt(energy[n:] - energy[:-n] + 1e-12)
    close = np.flatnonzero(score >= score.max() - 1e-9 * (1 + abs(score.max())))
    return int(close[np.abs(close - size // 2).argmin()])


def stretched(samples: DataFrame, ratio: float, window: int = 1024, tolerance: int = 256, block: int = 1 << 19) -> DataFrame:
    """(media_id, n, y): each clip (media_id, n, y) at ratio times its speed and its own pitch, ceil(samples / ratio) long.

    Segments of `window` samples are laid down every half of it under a Hann window. Segment k
    is taken near k * ratio half windows, at most `tolerance` away, where it goes on best from
    the one before. Each needs the one before, so blocks of source samples follow each other,
    and each block is a job over all clips: a task holds a block of a clip and its margins,
    and a checkpoint carries where the last segment was and what it still adds. Missing
    samples and those beyond the ends are 0. ratio 1 gives the samples back.
    """
    from ..sources.tables import checkpointed

    if ratio <= 0 or window % 2 or not 0 <= tolerance:
        raise ValueError("ratio is over 0, window even and tolerance not under 0")
    half = window // 2
    per_block = max(1, int(block / (half * ratio)))  # segments of a block
    sizes = samples.groupBy("media_id").agg((F.max("n") + 1).cast("long").alias("size"))
    longest = sizes.agg(F.max("size")).first()[0] or 0
    kind, types = _kinds(samples, ["media_id"]), [_arrow(samples, "media_id")]
    state = sizes.select("media_id", "size", F.lit(0).cast("long").alias("at"), F.array().cast("array<double>").alias("tail"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("y"))
    names, schema = ["media_id", "size", "at", "tail", "n", "y"], f"{kind}, size long, at long, tail array<double>, n long, y double"
    shape = hann(window)

    def lay(first: int):
        def run(key: tuple, state: pa.Table, rows: pa.Table) -> pa.Table:
            if not len(state):
                return pa.Table.from_arrays([pa.array([], t) for t in (*types, pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64())], names=names)
            size, at, tail = state.column("size")[0].as_py(), state.column("at")[0].as_py(), np.array(state.column("tail")[0].as_py(), float)
            out_size = int(np.ceil(size / ratio))
            last = min(first + per_block, -(-out_size // half) + 1)  # one segment beyond the end
            base = int(round(first * half * ratio)) - tolerance - 2 * window
            wave = np.zeros(int(round(last * half * ratio)) + tolerance + 3 * window - base + half)
            n = rows.column("n").to_numpy().astype(np.int64) - base
            here = (n >= 0) & (n < len(wave))
            wave[n[here]] = rows.column("y").fill_null(0.0).to_numpy()[here]
            out = np.zeros((max(0, last - first) + 1) * half)
            out[: len(tail)] += tail
            for k in range(first, last):
                place = int(round(k * half * ratio)) - half - base  # segment k is centred there
                if k:
                    natural = wave[at + half - base : at + half - base + window]
                    place += best_shift(natural, wave[place - tolerance : place + tolerance + window]) - tolerance
                at = place + base
                piece = wave[place : place + window] * shape
                o = (k - first) * half  # of the output, from first * half - half on
                out[o : o + window] += piece[: len(out) - o]
            done = max(0, last - first) * half
            n = np.arange(first * half - half, first * half - half + done)
            keep = (n >= 0) & (n < out_size)
            m = int(keep.sum())
            columns = [pa.array([size] * (m + 1), pa.int64()), pa.array([at] * (m + 1), pa.int64()), pa.array([out[done:].tolist()] + [None] * m, pa.list_(pa.float64())), pa.array([None, *n[keep].tolist()], pa.int64()), pa.array([None, *out[:done][keep].tolist()], pa.float64())]
            return pa.Table.from_arrays([*_repeated(key, types, m + 1), *columns], names=names)

        return run

    out = None
    segments = -(-int(np.ceil(longest / ratio)) // half) + 1 if longest else 0
    for first in range(0, segments, per_block):
        lo = int(round(first * half * ratio)) - tolerance - 2 * window
        hi = int(round((first + per_block) * half * ratio)) + tolerance + 3 * window
        part = samples.where(F.col("n").between(lo, hi)).select(F.col("media_id").alias("clip"), "n", "y")
        found = checkpointed(state.groupBy("media_id").cogroup(part.groupBy("clip")).applyInArrow(lay(first), schema))
        new = found.where(F.col("n").isNotNull()).select("media_id", "n", "y")
        out, state = new if out is None else out.unionByName(new), found.where(F.col("n").isNull())
    return out if out is not None else samples.select("media_id", F.col("n").cast("long").alias("n"), F.col("y").cast("double").alias("y")).limit(0)
