"""8-bit hue, saturation and value of known colours, and equalisation that uses all levels."""

import colorsys

import pytest
from pyspark.sql import functions as F

from framelytics.operators import colour as C

#: Blue, green, red -> hue / 2, saturation, value.
KNOWN = {(0, 0, 255): (0, 255, 255), (0, 255, 0): (60, 255, 255), (255, 0, 0): (120, 255, 255), (0, 255, 255): (30, 255, 255), (255, 255, 0): (90, 255, 255), (255, 0, 255): (150, 255, 255), (128, 128, 128): (0, 0, 128), (0, 0, 0): (0, 0, 0), (64, 128, 192): (15, 170, 192)}


def test_known_colours(spark):
    df = spark.createDataFrame(list(KNOWN), "b int, g int, r int")
    found = df.select("*", *[c.alias(n) for c, n in zip(C.to_hsv(F.col("b"), F.col("g"), F.col("r")), "hsv", strict=True)]).collect()
    assert {(x["b"], x["g"], x["r"]): (x["h"], x["s"], x["v"]) for x in found} == KNOWN


def test_there_and_back_is_within_the_steps(spark):
    df = spark.range(4096).select(((F.col("id") % 16) * 17).cast("int").alias("b"), (F.floor(F.col("id") / 16) % 16 * 17).cast("int").alias("g"), (F.floor(F.col("id") / 256) * 17).cast("int").alias("r"))
    hsv = df.select("*", *[c.alias(n) for c, n in zip(C.to_hsv(F.col("b"), F.col("g"), F.col("r")), "hsv", strict=True)])
    rows = hsv.select("*", *[c.alias(n) for c, n in zip(C.from_hsv(F.col("h"), F.col("s"), F.col("v")), ("b2", "g2", "r2"), strict=True)]).collect()
    for x in rows:
        h, s, _ = colorsys.rgb_to_hsv(x["r"] / 255, x["g"] / 255, x["b"] / 255)
        assert min(abs(x["h"] - h * 180), 180 - abs(x["h"] - h * 180)) <= 0.6 and abs(x["s"] - s * 255) <= 0.51
        assert max(abs(x["b"] - x["b2"]), abs(x["g"] - x["g2"]), abs(x["r"] - x["r2"])) <= 5  # a step of hue is a thirtieth of a side


def test_values_spread(spark):
    gram = spark.createDataFrame([(0, 0, p, c, (100 + 2 * p) // (c + 1)) for p in range(16) for c in range(3)] + [(1, 0, p, c, 90) for p in range(4) for c in range(3)], "media_id int, frame_idx int, pos int, c int, v int")
    rows = C.equalise_hsv(gram).collect()
    blue = sorted((r["pos"], r["v"]) for r in rows if r["media_id"] == 0 and r["c"] == 0)
    assert [v for _, v in blue] == [pytest.approx(255 * k / 15, abs=0.51) for k in range(16)]
    assert {r["v"] for r in rows if r["media_id"] == 1} == {90}
