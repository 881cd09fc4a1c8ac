"""Boxes and landmarks from the maps of an anchor-free detector, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of the image for each cell of a map.
STRIDE = 4


def decode(maps: DataFrame, cells: int, height: int, width: int, threshold: float = 0.1, landmarks: int = 5) -> DataFrame:
    """(media_id, frame_idx, box, x1, y1, x2, y2, score, and lx1, ly1, ... of each landmark) of the cells whose heat is over threshold.

    maps: (media_id, frame_idx, heat, scale_y, scale_x, offset_y, offset_x, landmark), arrays by
    rows of `cells` cells; landmark is an array of such arrays, y before x for each. A box has
    its centre at the cell's, moved by the offset, and e ** scale cells for its sides, cut at
    the image; box is the cell's place. Landmarks are in parts of the uncut sides from the box's corner.
    """
    seen = maps.select("*", F.posexplode("heat").alias("box", "score")).where(F.col("score") > threshold)
    at = lambda name: F.get(name, F.col("box"))
    row, column = F.floor(F.col("box") / cells), F.col("box") % cells
    seen = seen.withColumns({"_h": F.exp(at("scale_y")) * STRIDE, "_w": F.exp(at("scale_x")) * STRIDE})

    def within(v: Column, most: int) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))

    seen = seen.withColumns({"x1": within((column + at("offset_x") + 0.5) * STRIDE - F.col("_w") / 2, width), "y1": within((row + at("offset_y") + 0.5) * STRIDE - F.col("_h") / 2, height)})
    cut = [F.least(F.col("x1") + F.col("_w"), F.lit(float(width))).alias("x2"), F.least(F.col("y1") + F.col("_h"), F.lit(float(height))).alias("y2")]
    mark = lambda k: F.get(F.get("landmark", F.lit(k)), F.col("box"))
    marks = [c for j in range(landmarks) for c in ((mark(2 * j + 1) * F.col("_w") + F.col("x1")).alias(f"lx{j + 1}"), (mark(2 * j) * F.col("_h") + F.col("y1")).alias(f"ly{j + 1}"))]
    return seen.select("media_id", "frame_idx", "box", "x1", "y1", *cut, "score", *marks)
