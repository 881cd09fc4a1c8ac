"""Wave files by byte ranges and by tasks, against Python's wave module."""

import wave

import numpy as np
import pandas as pd
import pytest

from framelytics.sources import waves


def write(path, values, channels=1, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(values, "<i2").tobytes())


def test_a_long_file_goes_over_many_tasks(spark, tmp_path):
    values = np.random.default_rng(0).integers(-32768, 32768, (200_000, 2))
    write(tmp_path / "long.wav", values, 2)
    df = waves.read_waves(spark, str(tmp_path / "long.wav"), 50_001)  # ranges that cut samples
    assert df.rdd.getNumPartitions() == 17
    found = df.toPandas().sort_values("n")
    assert (found["n"].to_numpy() == np.arange(200_000)).all() and np.allclose(found["y"], values.mean(axis=1) / 32768)
    counts = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(counts) < 13_000


def test_short_files_share_a_task(spark, tmp_path):
    for k in range(20):
        write(tmp_path / f"{k}.wav", np.arange(k * 10))
    df = waves.read_waves(spark, str(tmp_path), 5_000)
    assert df.rdd.getNumPartitions() == 1
    sizes = {r["media_id"].rsplit("/", 1)[1]: r["count"] for r in df.groupBy("media_id").count().collect()}
    assert sizes == {f"{k}.wav": k * 10 for k in range(1, 20)}


def test_written_samples_come_back(spark, tmp_path):
    values = np.random.default_rng(1).integers(-32768, 32768, 30_000) / 32768
    rows = pd.concat([pd.DataFrame({"media_id": "a/b", "n": np.arange(30_000), "y": values}), pd.DataFrame({"media_id": "c", "n": [5, 6, 9], "y": [0.5, None, 2.0]})])
    waves.write_waves(spark.createDataFrame(rows.sample(frac=1, random_state=0)).repartition(7), str(tmp_path / "out"), 8000)
    found = waves.read_waves(spark, str(tmp_path / "out")).toPandas()
    own = found[found["media_id"] == "a/b"].sort_values("n")
    assert (own["n"].to_numpy() == np.arange(30_000)).all() and (own["y"].to_numpy() == values).all()
    rest = {r.n: r.y for r in found[found["media_id"] == "c"].itertuples()}
    assert rest == {5: 0.5, 6: 0.0, 9: 32767 / 32768}
    assert not list((tmp_path / "out").rglob(".n*"))  # nothing is left under a hidden name
    with wave.open(str(next((tmp_path / "out" / "c").glob("n5-*.wav")))) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (2, 8000, 1)


def test_what_is_no_wave(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFF0000WAVEfmt ")
    with pytest.raises(Exception, match="wave|unpack|samples"):
        waves.read_waves(spark, str(tmp_path)).collect()
