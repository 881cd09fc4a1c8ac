"""What the findings of round 3 asked about."""

import pytest

from framelytics.operators import features as V


@pytest.mark.parametrize("frames, text", [(750, "00:00:30.000"), (751, "00:00:30.040"), (5681, "00:03:47.240"), (89_999, "00:59:59.960"), (135_000, "01:30:00.000")])
def test_duration_counts_whole_minutes_and_hours(spark, frames, text):
    """Past half a minute or hour the parts are rounded down."""
    px = spark.createDataFrame([(0, frames - 1)], "media_id int, frame_idx int")
    row = V.clip_stats(px, 25.0, 16).first()
    assert (row["frames"], row["seconds"], row["duration"]) == (frames, frames // 25, text)


def test_set_ops_looks_at_every_key(spark, tmp_path):
    """Keys from 10 on have partners too, and those without one are named."""
    from framelytics.plans import registry

    spark.createDataFrame([(k,) for k in (3, 12, 12, 20, 24)], "c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in (3, 12, 21, 24, 24)], "s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(tuple, registry.QUERIES["set_ops"](spark, str(tmp_path)).collect())) == [(3, "s"), (12, "s"), (20, "c"), (24, "s")]


def test_pairs_of_a_clip_are_multiplied_without_a_copy_for_each_short_block(spark, monkeypatch):
    """Long clips are cut into a bounded number of blocks; gaps, several clips and small slices change no product."""
    import numpy as np

    from framelytics.operators import series as S

    monkeypatch.setattr(S, "BLOCKS", 4)
    monkeypatch.setattr(S, "PAIRS", 5)
    frames = {(m, k): [float(m + k % 5), float(k % 3), 1.0] for m, ks in ((0, range(120)), (1, [0, 1, 37, 59]), (2, [0])) for k in ks}
    features = spark.createDataFrame([(m, k, v) for (m, k), v in frames.items()], "media_id int, frame_idx int, vec array<double>")
    want = {(m, i, j): float(np.dot(frames[m, i], frames[m, j])) for m, i in frames for n, j in frames if n == m and i <= j}
    rows = S.self_similarity(features, 7).collect()
    assert len(rows) == len(want) and {(r.media_id, r.i, r.j): r.s for r in rows} == want
    # 120 frames in 4 blocks of 30, not in 18 of 7, 4 frames in 4 blocks of 15, and 1.
    assert S.pairs_of_blocks(features, 7).count() == 120 * 4 + 4 * 4 + 1
    # Clips whose vectors differ in size may come in one batch.
    uneven = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [3.0])], "media_id int, frame_idx int, vec array<double>").coalesce(1)
    assert sorted(map(tuple, S.self_similarity(uneven).collect())) == [(0, 0, 0, 5.0), (1, 0, 0, 9.0)]
