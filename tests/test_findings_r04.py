"""What the findings of round 4 asked about."""

import glob

import numpy as np
import pyarrow.parquet as pq

from framelytics.operators import series as S


def numbered_vectors(spark, frames: int, clips: int = 1):
    return spark.range(frames * clips).selectExpr(f"cast(id div {frames} AS int) AS media_id", f"cast(id % {frames} AS int) AS frame_idx", "array(cast(id % 7 AS double), 1D) AS vec")


def test_places_of_pairs_take_little_in_a_file(spark, tmp_path, monkeypatch):
    """A long block's frames j come in short cycles, which a file holds in little; in one long cycle they took 0.74 bytes a pair here."""
    monkeypatch.setattr(S, "BLOCKS", 1)
    S.self_similarity(numbered_vectors(spark, 3000)).write.parquet(f"{tmp_path}/s")
    size, rows = 0, 0
    for file in glob.glob(f"{tmp_path}/s/*.parquet"):
        meta = pq.read_metadata(file)
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            rows += group.num_rows
            size += sum(c.total_compressed_size for c in map(group.column, range(group.num_columns)) if c.path_in_schema in ("i", "j"))
    assert rows == 3000 * 3001 // 2 and size < 0.25 * rows


def test_pairs_are_made_by_as_many_tasks_as_are_set(spark):
    """Few bytes of frames make many pairs, so Spark may not join the tasks that make them."""
    pairs = S.self_similarity(numbered_vectors(spark, 60, 5), 7)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_strips_change_no_pair(spark, monkeypatch):
    """Strips that end within a block, gaps and blocks of one frame."""
    monkeypatch.setattr(S, "STRIP", 3)
    monkeypatch.setattr(S, "PAIRS", 5)
    frames = {(m, k): [float(m + k % 5), float(k % 3), 1.0] for m, ks in ((0, range(50)), (1, [0, 1, 9, 23, 24]), (2, [4])) for k in ks}
    features = spark.createDataFrame([(m, k, v) for (m, k), v in frames.items()], "media_id int, frame_idx int, vec array<double>")
    want = {(m, i, j): float(np.dot(frames[m, i], frames[m, j])) for m, i in frames for n, j in frames if n == m and i <= j}
    rows = S.self_similarity(features, 8).collect()
    assert len(rows) == len(want) and {(r.media_id, r.i, r.j): r.s for r in rows} == want
