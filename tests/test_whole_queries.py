"""Queries over whole tables: each clip, each pair of columns."""

from framelytics.plans import registry
from framelytics.sources import adapters


def test_every_clip_and_pair(spark, data):
    px, joined = adapters.pixels(spark, data), registry.QUERIES["concat_all_clips"](spark, data)
    frames = px.select("media_id", "frame_idx").distinct().count()
    assert joined.count() == px.count() and {r["frame_idx"] for r in joined.select("frame_idx").distinct().collect()} == set(range(frames))
    columns = registry.QUERIES["corr_columns"](spark, data).columns
    assert {"qp", "qd", "qt", "pd", "pt", "dt"} <= set(columns) and len(columns) == 6 + 4 * 4
    assert {"concat_all_clips", "set_ops_all", "corr_columns"} <= set(registry.SQL)
