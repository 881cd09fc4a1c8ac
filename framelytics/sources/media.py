"""A Python data source of PCM wave files, and tables of frames and metadata."""

from __future__ import annotations

import io
import wave

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = T.StructType([T.StructField("media_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("y", T.DoubleType())])


def read_wave(spark: SparkSession, path: str) -> DataFrame:
    """Samples of 16-bit PCM files, channels averaged, in -1..1. Files are read by Spark, decoded in its tasks."""
    import numpy as np
    import pandas as pd

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    channels, at = w.getnchannels(), 0
                    while raw := w.readframes(1 << 20):
                        y = np.frombuffer(raw, "<i2").reshape(-1, channels).mean(axis=1) / 32768
                        yield pd.DataFrame({"media_id": name, "n": np.arange(at, at + len(y)), "y": y})
                        at += len(y)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SAMPLES)


def metadata(lines: DataFrame) -> DataFrame:
    """(media_id, codec_type, kv) from probe text, one stream's key=value lines a row."""
    kv = F.str_to_map("text", F.lit("\n"), F.lit("="))
    return lines.select("media_id", F.try_element_at(kv, F.lit("codec_type")).alias("codec_type"), kv.alias("kv"))


def concatenate(clips: list[DataFrame]) -> DataFrame:
    """Clips (media_id, frame_idx, y, x, v) joined end to end as one; they need one size."""
    if not clips:
        raise ValueError("nothing to concatenate")
    sizes = [c.agg(F.max("frame_idx").alias("n"), F.max("y").alias("h"), F.max("x").alias("w")).first() for c in clips]
    if len({(s["h"], s["w"]) for s in sizes}) > 1:
        raise ValueError("clips of different sizes")
    out, at = None, 0
    for clip, s in zip(clips, sizes):
        moved = clip.withColumns({"media_id": F.lit(0), "frame_idx": F.col("frame_idx") + at})
        out = moved if out is None else out.unionByName(moved)
        at += s["n"] + 1
    return out


def write_series(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Motion, pose or box series as csv, tsv or txt with a header."""
    marks = {"csv": ",", "tsv": "\t", "txt": " "}
    if kind not in marks:
        raise ValueError(f"unknown format {kind}")
    shown = df.select([F.format_string("%.15f", c).alias(c) if t == "double" and kind != "csv" else F.col(c) for c, t in df.dtypes])
    shown.write.mode("errorifexists").csv(path, sep=marks[kind], header=True)
