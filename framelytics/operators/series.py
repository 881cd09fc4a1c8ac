"""Operators on series (media_id, n, y), spectra, similarity, detections and statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iou
from .spectra import in_blocks


def _order():
    return Window.partitionBy("media_id").orderBy("n")


def quartiles(s: DataFrame) -> DataFrame:
    """Of y over the clip's greatest, without its first value: quartiles, and whiskers clipped to the first and last value in time."""
    s = s.where("n >= 1")
    scaled = s.join(s.groupBy("media_id").agg(F.max("y").alias("most")), "media_id").withColumn("q", F.col("y") / F.col("most"))
    p = scaled.groupBy("media_id").agg(F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.min_by("q", "n").alias("first"), F.max_by("q", "n").alias("last"))
    q1, q3 = F.get("p", F.lit(0)), F.get("p", F.lit(2))
    spread = 1.5 * (q3 - q1)
    upper, lower = F.least(F.greatest(q3 + spread, q3), F.col("last")), F.least(F.greatest(q1 - spread, F.col("first")), q1)
    return p.select("media_id", q1.alias("q1"), F.get("p", F.lit(1)).alias("q2"), q3.alias("q3"), lower.alias("lower"), upper.alias("upper"))


def smooth_downsample(s: DataFrame, length: int, step: int) -> DataFrame:
    """Boxcar sum over length values (missing ones are 0) divided by it, every step-th kept."""
    r = length // 2
    blocks, order, own = in_blocks(s, ["media_id"], "n", r, r)
    total = F.sum("y").over(order.rowsBetween(-r, r)) / length
    return blocks.select("media_id", "n", "_b", total.alias("y")).where(own & (F.col("n") % step == 0)).drop("_b").withColumn("n", F.floor(F.col("n") / step).cast("int"))


def impact_envelope(directograms: DataFrame, bins: int = 100, k: int = 5, share: float = 0.98) -> DataFrame:
    """(media_id, n, y) of (media_id, frame_idx, bin, mag): summed rises of the k x k median over frames and bins.

    Beyond the ends there are zeros; the first frame has no rise; sums, to 9 digits so that
    equal ones compare as equal, over the percentile
    become 0, the rest is divided by the greatest left. Frames are arrays of their bins.
    frame_idx counts 0, 1, ... up to the last frame that has any bin.
    """
    r = k // 2
    lengths = directograms.groupBy("media_id").agg(F.max("frame_idx").alias("last"))
    every = lengths.select("media_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame_idx"))
    found = directograms.groupBy("media_id", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("bin", "mag"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    frames = every.join(found, ["media_id", "frame_idx"], "left").select("media_id", "frame_idx", vec.alias("vec"))
    blocks, order, own = in_blocks(frames, ["media_id"], "frame_idx", r + 1, r)
    near = blocks.withColumn("near", F.collect_list("vec").over(order.rowsBetween(-r, r)))
    seen = lambda b: F.flatten(F.transform("near", lambda v: F.slice(v, F.greatest(b - r + 1, F.lit(1)), F.least(b + r, F.lit(bins - 1)) - F.greatest(b - r, F.lit(0)) + 1)))
    middle = lambda values: F.get(F.sort_array(F.concat(values, F.array_repeat(F.lit(0.0), k * k - F.size(values)))), F.lit(k * k // 2))
    smooth = near.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: middle(seen(b)))).drop("near")
    before = F.lag("vec").over(order)
    rise = F.aggregate(F.zip_with("vec", before, lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    rises = smooth.select("media_id", F.col("frame_idx").alias("n"), F.col("frame_idx"), "_b", F.round(F.coalesce(rise, F.lit(0.0)), 9).alias("d")).where(own).drop("_b", "frame_idx")
    rises = rises.repartition("media_id", "n")  # the same exchange for all that follows, so that it is made once
    limit = rises.groupBy("media_id").agg(F.percentile("d", F.lit(share)).alias("limit"))
    cut = rises.join(limit, "media_id").select("media_id", "n", F.when(F.col("d") > F.col("limit"), 0.0).otherwise(F.col("d")).alias("d"))
    most = cut.groupBy("media_id").agg(F.max("d").alias("most"))
    return cut.join(most, "media_id").select("media_id", "n", F.when(F.col("most") > 0, F.col("d") / F.col("most")).otherwise(0.0).alias("y"))


def impacts(s: DataFrame, k: int, m: int, share: float = 0.1) -> DataFrame:
    """Values above all within m on both sides, and above the mean of the k before and after by a share of the greatest."""
    k, m = max(1, k), max(1, m)
    blocks, order, own = in_blocks(s, ["media_id"], "n", max(k, m), max(k, m))
    mean = (F.avg("y").over(order.rowsBetween(-k, -1)) + F.avg("y").over(order.rowsBetween(1, k))) / 2
    near = F.greatest(F.max("y").over(order.rowsBetween(-m, -1)), F.max("y").over(order.rowsBetween(1, m)))
    seen = blocks.select("media_id", "n", "_b", "y", mean.alias("mean"), near.alias("near")).where(own).drop("_b")
    most = s.groupBy("media_id").agg(F.max("y").alias("most"), F.count("*").alias("len"))
    inside = (F.col("n") >= m + 4) & (F.col("n") < F.col("len") - m - 4)
    return seen.join(most, "media_id").where(inside & (F.col("y") > F.col("near")) & (F.col("y") - F.col("mean") > share * F.col("most"))).select("media_id", "n", "y")


def intervals(beats: DataFrame, lengths: DataFrame) -> DataFrame:
    """(media_id, k, n, step, total): the first beat, steps between beats, and what is left of the length after the last; total is their running sum.

    That sum is the beat itself, and the length at the end, so it needs no second window.
    """
    step = beats.select("media_id", (F.row_number().over(_order()) - 1).cast("long").alias("k"), "n", (F.col("n") - F.lag("n", 1, 0).over(_order())).cast("long").alias("step"), F.col("n").cast("long").alias("total"))
    ends = beats.groupBy("media_id").agg(F.count("*").alias("k"), F.max("n").alias("last")).join(lengths, "media_id")
    tail = ends.select("media_id", "k", F.lit(None).cast(beats.schema["n"].dataType).alias("n"), (F.col("len") - F.col("last")).cast("long").alias("step"), F.col("len").cast("long").alias("total"))
    return step.unionByName(tail)


def asof(left: DataFrame, right: DataFrame, at: str = "ts", value: str = "v") -> DataFrame:
    """left with the last non-null right value at or before its time, per media_id: union, then one window."""
    both = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    both = both.unionByName(right.select("media_id", at, value).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    seen = Window.partitionBy("media_id").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(seen)).where("_left = 1").drop("_left")


def warp_resample(s: DataFrame, segments: DataFrame) -> DataFrame:
    """Output times mapped linearly into source segments (media_id, a0, a1, v0, v1), then the nearest sample taken."""
    out = segments.select("media_id", "a0", "a1", "v0", "v1", F.explode(F.sequence("a0", F.col("a1") - 1)).alias("t")).where("a1 > a0")
    source = F.rint(F.col("v0") + (F.col("t") - F.col("a0")) * (F.col("v1") - F.col("v0")) / (F.col("a1") - F.col("a0"))).cast("int")
    return out.select("media_id", "t", source.alias("n")).join(s.select("media_id", "n", "y"), ["media_id", "n"])


def loop_extend(s: DataFrame, length: int) -> DataFrame:
    """The series repeated up to a length."""
    size = s.groupBy("media_id").agg(F.count("*").alias("len"))
    out = size.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"), "len")
    return out.select("media_id", "t", (F.col("t") % F.col("len")).cast("int").alias("n")).join(s.select("media_id", "n", "y"), ["media_id", "n"])


def waveform_peaks(s: DataFrame, block: int) -> DataFrame:
    """Least and greatest of each block, in the order in which they come first."""
    b = s.groupBy("media_id", F.floor(F.col("n") / block).cast("int").alias("block")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min_by("n", F.struct("y", "n")).alias("lo_at"), F.min_by("n", F.struct(-F.col("y"), "n")).alias("hi_at"))
    early = F.col("lo_at") <= F.col("hi_at")
    return b.select("media_id", "block", F.when(early, F.col("lo")).otherwise(F.col("hi")).alias("first"), F.when(early, F.col("hi")).otherwise(F.col("lo")).alias("second"))


def stft(frames: DataFrame, size: int) -> DataFrame:
    """(media_id, frame_idx, k, mag) of vectors under a periodic Hann window, as a sum over a literal basis."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]

    def part(wave) -> list:
        return [F.array(*[F.lit(hann[i] * wave(2 * math.pi * k * i / size)) for i in range(size)]) for k in range(size // 2 + 1)]

    dot = lambda basis: F.aggregate(F.zip_with("vec", basis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    waves = F.arrays_zip(F.array(*part(math.cos)).alias("c"), F.array(*part(math.sin)).alias("s"))
    mags = F.transform(waves, lambda w: F.sqrt(F.pow(dot(w["c"]), 2) + F.pow(dot(w["s"]), 2)))
    return frames.select("media_id", "frame_idx", F.posexplode(mags).alias("k", "mag"))


def spectral(spec: DataFrame, roll: float = 0.85) -> DataFrame:
    """Centroid, bandwidth, flatness and roll-off of each frame, in bins."""
    per = ["media_id", "frame_idx"]
    c = spec.groupBy(*per).agg((F.sum(F.col("k") * F.col("mag")) / F.sum("mag")).alias("centroid"), F.sum("mag").alias("total"), (F.exp(F.avg(F.ln(F.greatest(F.lit(1e-10), F.col("mag") * F.col("mag"))))) / F.avg(F.greatest(F.lit(1e-10), F.col("mag") * F.col("mag")))).alias("flatness"))
    run = F.sum("mag").over(Window.partitionBy(*per).orderBy("k"))
    both = spec.withColumn("run", run).join(c, per)
    return both.groupBy(*per).agg(F.first("centroid").alias("centroid"), F.sqrt(F.sum(F.col("mag") / F.col("total") * F.pow(F.col("k") - F.col("centroid"), 2))).alias("bandwidth"), F.first("flatness").alias("flatness"), F.min(F.when(F.col("run") >= roll * F.col("total"), F.col("k"))).alias("rolloff"))


def power_db(spec: DataFrame, top_db: float = 80.0) -> DataFrame:
    """10 log10 of power over the clip's greatest, not under -top_db."""
    most = spec.groupBy("media_id").agg(F.max(F.col("mag") * F.col("mag")).alias("most"))
    db = 10 * F.log10(F.greatest(F.lit(1e-10), F.col("mag") * F.col("mag")) / F.greatest(F.lit(1e-10), F.col("most")))
    return spec.join(most, "media_id").select("media_id", "frame_idx", "k", F.greatest(db, F.lit(-top_db)).alias("db"))


def onset_strength(db: DataFrame) -> DataFrame:
    """Mean over bands of the rise in dB since the frame before."""
    before = F.lag("db").over(Window.partitionBy("media_id", "k").orderBy("frame_idx"))
    rise = db.select("media_id", "frame_idx", F.greatest(F.col("db") - before, F.lit(0.0)).alias("r")).fillna(0.0, ["r"])
    return rise.groupBy("media_id", "frame_idx").agg(F.avg("r").alias("onset"))


def autocorrelation(s: DataFrame, lags: int) -> DataFrame:
    """Sum of products of a series with itself at each lag."""
    blocks, order, own = in_blocks(s, ["media_id"], "n", lags, 0)
    products = blocks.select("media_id", "n", "_b", F.array(*[F.col("y") * F.lag("y", k).over(order) for k in range(lags)]).alias("p")).where(own)
    return products.select("media_id", F.posexplode("p").alias("lag", "p")).groupBy("media_id", "lag").agg(F.sum("p").alias("r"))


def normalised(features: DataFrame, norm: float | str = "max", threshold: float = 1e-3) -> DataFrame:
    """vec divided by its norm, unless that is under the threshold. norm: 1, 2, inf or -inf (largest and least absolute value); "max" and "l2" are inf and 2."""
    norm = {"max": math.inf, "l2": 2}.get(norm, norm)
    size = {
        1: F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)),
        2: F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)),
        math.inf: F.array_max(F.transform("vec", F.abs)),
        -math.inf: F.array_min(F.transform("vec", F.abs)),
    }[norm]
    return features.withColumn("_size", size).withColumn("vec", F.transform("vec", lambda x: F.when(F.col("_size") >= threshold, x / F.col("_size")).otherwise(x))).drop("_size")


#: Blocks that a longer clip is cut into, frames of a block at most, pairs that a task holds at once, and frames j that it goes through for each i before the next ones.
BLOCKS, LONGEST_BLOCK, PAIRS, STRIP = 16, 32768, 500_000, 512


def pairs_of_blocks(features: DataFrame, block: int) -> DataFrame:
    """Each frame once for every block of its clip: (media_id, bi, bj, b, frame_idx, vec), where b is bi or bj.

    Blocks have `block` frames, or more where a clip has over BLOCKS of them, so the rows
    grow with the frames until blocks of LONGEST_BLOCK are too many.
    """
    own = features.select(F.col("media_id").cast("int").alias("media_id"), F.col("frame_idx").cast("int").alias("frame_idx"), "vec")
    size = F.greatest(F.lit(block), F.least(F.ceil((F.max("frame_idx") + 1) / BLOCKS), F.lit(LONGEST_BLOCK))).cast("int")
    sizes = own.groupBy("media_id").agg(size.alias("size"), F.max("frame_idx").alias("last"))
    b = F.floor(F.col("frame_idx") / F.col("size")).cast("int")
    sent = own.join(sizes, "media_id").withColumn("b", b).withColumn("other", F.explode(F.expr("sequence(0, cast(floor(last / size) as int))")))
    return sent.select("media_id", F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), "b", "frame_idx", "vec")


def self_similarity(features: DataFrame, block: int = 512) -> DataFrame:
    """(media_id, i, j, s) for i <= j: dot products of a clip's vectors, by pairs of blocks of bounded size.

    The result itself has a row per pair, as its definition asks. Pairs come in strips of
    STRIP frames j, as a short cycle of j repeats within a page of a file and takes little there.
    """
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as Spark would join those of few bytes, which make many rows

    def products(media: int, alone: bool, b: np.ndarray, at: np.ndarray, vec: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of a pair of blocks; alone: a block with itself."""
        left, right = b == b[0], b == b[-1]
        if not alone and b[0] == b[-1]:  # the other block has no frame
            return
        (i, v), (j, w) = (at[left], vec[left]), (at[right], vec[right])
        rows = max(1, PAIRS // min(len(j), STRIP))
        for c in range(0, len(j), STRIP):
            strip, x = j[c : c + STRIP], w[c : c + STRIP].T
            for k in range(0, len(i), rows):
                if alone and i[k] > strip[-1]:  # frames are in order
                    break
                s = (v[k : k + rows] @ x).ravel()
                first, second = np.repeat(i[k : k + rows], len(strip)), np.tile(strip, len(s) // len(strip))
                if alone:
                    kept = first <= second
                    first, second, s = first[kept], second[kept], s[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), media, np.int32)), pa.array(first), pa.array(second), pa.array(s)], names=["media_id", "i", "j", "s"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair of blocks; the last pair of a batch waits for the next."""
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            b, at, vec = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if key is not None and key != tuple(keys[start]):
                    yield from products(int(key[0]), key[1] == key[2], *map(np.concatenate, zip(*held)))
                    held = []
                key = tuple(keys[start])
                held.append((b[start:end], at[start:end], np.stack(vec[start:end])))  # clips may differ in the vectors' size
        if held:
            yield from products(int(key[0]), key[1] == key[2], *map(np.concatenate, zip(*held)))

    return pairs_of_blocks(features, block).repartition(tasks, "media_id", "bi", "bj").sortWithinPartitions("media_id", "bi", "bj", "frame_idx").mapInArrow(multiply, "media_id int, i int, j int, s double")


def suppressed(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Boxes that stay when each, by falling score, removes those that overlap it by `most` or more."""

    def greedy(b: np.ndarray) -> list[int]:
        area, kept, left = (b[:, 2] - b[:, 0] + 1) * (b[:, 3] - b[:, 1] + 1), [], np.arange(len(b))
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            w = np.minimum(b[i, 2], b[left, 2]) - np.maximum(b[i, 0], b[left, 0]) + 1
            h = np.minimum(b[i, 3], b[left, 3]) - np.maximum(b[i, 1], b[left, 1]) + 1
            inner = np.maximum(w, 0) * np.maximum(h, 0)
            left = left[inner / (area[i] + area[left] - inner) < most]
        return kept

    def by_frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by frame; the last frame of a batch waits for the next."""
        rest = None
        for pdf in chain(batches, [None]):
            rows = pd.concat([x for x in (rest, pdf) if x is not None]) if rest is not None or pdf is not None else None
            if rows is None or not len(rows):
                continue
            frame = rows["frame_idx"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], frame[1:] != frame[:-1]]))
            ends = [*cuts[1:], len(rows)]
            if pdf is not None:
                rest, cuts, ends = rows.iloc[cuts[-1] :], cuts[:-1], ends[:-1]
            b = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
            kept = [i + k for i, e in zip(cuts, ends) for k in greedy(b[i:e])]
            yield rows.iloc[kept]

    return boxes.repartition("frame_idx").sortWithinPartitions("frame_idx", F.desc("score"), "box").mapInPandas(by_frame, boxes.schema)


def overlaps(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes of one frame with an overlap of at least `least`."""
    a, b = (boxes.select("frame_idx", *[F.col(c).alias(f"{p}{c}") for c in ("box", "x1", "y1", "x2", "y2")]) for p in ("a_", "b_"))
    return a.join(b, "frame_idx").where("a_box < b_box").withColumn("iou", iou("a_", "b_")).where(F.col("iou") >= least).select("frame_idx", "a_box", "b_box", "iou")


def box_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """How many points (frame_idx, px, py) each box of the same frame holds."""
    inside = points.join(boxes, "frame_idx").where("px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2")
    return inside.groupBy("frame_idx", "box").agg(F.count("*").alias("n"))


def heat_grid(points: DataFrame, cells: int, size: float, k: int) -> DataFrame:
    """Over a grid of cells x cells: 1 over the sum of distances to the k nearest of the points (x, y).

    The grid is bounded and each task keeps k distances a cell, so only those are shuffled.
    """
    centres = [(i, j, (i + 0.5) * size / cells, (j + 0.5) * size / cells) for i in range(cells) for j in range(cells)]

    def nearest(batches):
        gx, gy = np.array([c[2] for c in centres]), np.array([c[3] for c in centres])
        best = np.full((len(centres), 0), 0.0)
        for pdf in batches:
            p = pdf[["x", "y"]].dropna().to_numpy(float)
            for at in range(0, len(p), 4096):
                d = np.hypot(gx[:, None] - p[None, at : at + 4096, 0], gy[:, None] - p[None, at : at + 4096, 1])
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        yield pd.DataFrame([(i, j, float(x)) for (i, j, _, _), row in zip(centres, best) for x in row], columns=["i", "j", "d"])

    near = points.select("x", "y").mapInPandas(nearest, "i int, j int, d double")
    few = near.groupBy("i", "j").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    return few.select("i", "j", F.when(total > 0, 1 / total).alias("heat"))


def part_variance(points: DataFrame) -> DataFrame:
    """Mean over parts and coordinates of the sample variance."""
    v = points.groupBy("media_id", "part").agg(((F.var_samp("px") + F.var_samp("py")) / 2).alias("v"))
    return v.groupBy("media_id").agg(F.avg("v").alias("activity"))


def movement(points: DataFrame) -> DataFrame:
    """Per clip over frames: mean, greatest, population deviation of the mean step of its parts, and frames over mean + deviation."""
    order = Window.partitionBy("media_id", "part").orderBy("frame_idx")
    step = F.sqrt(F.pow(F.col("px") - F.lag("px").over(order), 2) + F.pow(F.col("py") - F.lag("py").over(order), 2))
    frames = points.select("media_id", "frame_idx", step.alias("s")).groupBy("media_id", "frame_idx").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("m"))
    stats = frames.groupBy("media_id").agg(F.avg("m").alias("avg"), F.max("m").alias("max"), F.stddev_pop("m").alias("std"))
    over = frames.join(stats, "media_id").groupBy("media_id").agg(F.count_if(F.col("m") > F.col("avg") + F.col("std")).alias("peaks"))
    return stats.join(over, "media_id")


def skeleton(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Length of each edge (a, b) in each frame; both ends must be there. edges: a literal table."""
    a, b = (points.select("media_id", "frame_idx", F.col("part").alias(p), F.col("px").alias(f"{p}x"), F.col("py").alias(f"{p}y")) for p in ("a", "b"))
    both = a.join(F.broadcast(edges), "a").join(b, ["media_id", "frame_idx", "b"])
    return both.select("media_id", "frame_idx", "a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("length"))


def batch_stats(t: DataFrame, by: str, value: str, active: float) -> DataFrame:
    v = F.col(value)
    return t.groupBy(by).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.stddev_samp(v).alias("std"), F.count_if(v > active).alias("n_active"), (100.0 * F.count_if(v > active) / F.count("*")).alias("percent_active"))
