"""Frames, signals, boxes and features derived from the test tables, which hold no media.

These mappings are this package's own. Pixels are 8 x 8 gray frames with integer values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """df with the place of each row among its key's in this order, from 0, by buckets that follow the order.

    Rows are numbered within a bucket and the buckets before it are added, so that a key of
    many rows is spread over tasks; only a row a bucket goes through a window by key.
    """
    own = df.withColumn("_bucket", bucket)
    sizes = own.groupBy(key, "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_own"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    both = own.withColumn("_place", place).join(starts, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_own")))
    return both.select(*df.columns, (F.col("_start") + F.col("_place")).cast("int").alias(name))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame_idx, vec): one clip per label, its vectors in order."""
    found = numbered(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], F.floor(F.col("vec_id") / 4096), "frame_idx")
    return found.select(F.col("label").alias("media_id"), "frame_idx", F.col("embedding").cast("array<double>").alias("vec"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame_idx, y, x, v): each frame's 64 values as gray levels."""
    level = F.floor(F.least(F.greatest((F.col("e") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    cells = clips(spark, sf_dir).select("media_id", "frame_idx", F.posexplode("vec").alias("i", "e"))
    return cells.select("media_id", "frame_idx", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), level.alias("v"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame_idx, y, x, c, v): three channels, each the frame's values from a third further on."""
    cells = clips(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    cells = cells.select("media_id", "frame_idx", "vec", "c", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    e = F.get("vec", (F.col("i") + 21 * F.col("c")) % (SIDE * SIDE))
    level = F.floor(F.least(F.greatest((e + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    return cells.select("media_id", "frame_idx", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), "c", level.alias("v"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, text): what a prober prints of a file, made up from an event; facts are hidden in it as it prints them."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    time = F.format_string("%02d:%02d:%02d.%02d", F.floor(F.col("event_id") / 3600) % 24, F.floor(F.col("event_id") / 60) % 60, F.col("event_id") % 60, F.col("k"))
    video = F.concat(F.lit("    Stream #0:0(und): Video: h264 (High) (avc1 / 0x31637661), yuv420p, "), (F.col("k") + 100).cast("string"), F.lit("x"), (F.col("k") * 2 + 50).cast("string"), F.lit(" [SAR 1:1 DAR 4:3], 1200 kb/s, "), F.when(F.col("k") % 2 == 0, "25").otherwise("29.97"), F.lit(" fps, 25 tbr, 12800 tbn\n"))
    turned = F.when(F.col("k") % 5 == 0, "      displaymatrix: rotation of -90.00 degrees\n").otherwise("")
    audio = F.when(F.col("k") % 3 == 0, "    Stream #0:1(eng): Audio: aac (LC), 44100 Hz, stereo, fltp, 128 kb/s\n").otherwise("")
    return e.select(F.col("event_id").alias("media_id"), F.concat(F.lit("Input #0, mov, from 'x.mp4':\n  Duration: "), time, F.lit(", start: 0.000000, bitrate: 1330 kb/s\n"), video, turned, audio).alias("text"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, n, ts, y): events of a user in time order."""
    found = numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"), "n")
    return found.select(F.col("user_id").alias("media_id"), "n", "ts", F.col("value").alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, box, x1, y1, x2, y2, score): detections from line items, a frame per order."""
    x1, y1 = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").alias("box"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.floor(F.col("l_discount") * 100)).alias("x2"), (y1 + F.floor(F.col("l_tax") * 100)).alias("y2"), F.col("l_extendedprice").alias("score"),
    )


def coded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame_idx, type, size) from events and the number in their JSON."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("size"))
