"""Time stretch: length, pitch and level are kept, whatever the blocks."""

import numpy as np
import pandas as pd
import pytest

from framelytics.operators import stretch

SR = 8000


def clip(spark, clips):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"media_id": m, "n": np.arange(len(y)), "y": y}) for m, y in clips.items()]))


def waves(df):
    return {m: g.sort_values("n")["y"].to_numpy() for m, g in df.toPandas().groupby("media_id")}


def pitch(y):
    y = y[2000:-2000]
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y)), 1 << 17))
    return spectrum.argmax() * SR / (1 << 17)


@pytest.mark.parametrize("ratio", [0.75, 1.5])
def test_pitch_and_level_stay(spark, ratio):
    t = np.arange(20_000) / SR
    clips = {"a": np.sin(2 * np.pi * 440 * t), "b": 0.5 * np.sin(2 * np.pi * 311.1 * t[:12_000])}
    found = waves(stretch.stretched(clip(spark, clips), ratio))
    for m, hz in (("a", 440), ("b", 311.1)):
        assert len(found[m]) == int(np.ceil(len(clips[m]) / ratio))
        assert abs(pitch(found[m]) - hz) < 1
        middle = found[m][2000:-2000]
        assert middle.std() == pytest.approx(clips[m].std(), rel=0.02)
        assert abs(np.diff(middle)).max() < 1.1 * abs(np.diff(clips[m])).max()  # no clicks where segments meet


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(0)
    y = np.convolve(rng.standard_normal(15_000), np.ones(9) / 9, "same")
    whole = waves(stretch.stretched(clip(spark, {"a": y}), 0.8, 256, 64))["a"]
    parts = waves(stretch.stretched(clip(spark, {"a": y}), 0.8, 256, 64, block=4000))["a"]
    assert np.allclose(whole, parts, atol=1e-9)


def test_speed_of_one_gives_the_samples(spark):
    y = np.random.default_rng(1).standard_normal(5000)
    found = waves(stretch.stretched(clip(spark, {"a": y}), 1.0, 256, 64))["a"]
    assert len(found) == 5000 and np.allclose(found, y, atol=1e-9)


def test_nothing_and_bad_arguments(spark):
    df = clip(spark, {"a": np.zeros(3)})
    assert stretch.stretched(df.limit(0), 0.5).count() == 0
    assert waves(stretch.stretched(df, 0.5))["a"].tolist() == [0.0] * 6
    with pytest.raises(ValueError, match="ratio"):
        stretch.stretched(df, 0.0)
