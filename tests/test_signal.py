"""Spectra of real samples against numpy, on clips that go over several tasks."""

import numpy as np
import pandas as pd
import pytest

from framelytics.operators import signal as G
from framelytics.operators import spectra as T

SR = 22050


@pytest.fixture(scope="module")
def wave():
    t = np.arange(60_000) / SR
    y = np.sin(2 * np.pi * 440 * t) + 0.2 * np.random.default_rng(0).standard_normal(len(t))
    y[::9000] += 8
    return y


@pytest.fixture(scope="module")
def samples(spark, wave):
    short = np.arange(700.0)
    rows = [pd.DataFrame({"media_id": m, "n": np.arange(len(y)), "y": y}) for m, y in (("long", wave), ("short", short))]
    return spark.createDataFrame(pd.concat(rows).sample(frac=1, random_state=1)).cache()


def expected(y, n_fft=2048, hop=512):
    wide = np.pad(y, n_fft // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.array([np.fft.rfft(wide[k : k + n_fft] * window) for k in range(0, len(y) + 1, hop)])


def test_frames_equal_numpy(spark, samples, wave):
    found = G.stft(samples, block=16)
    rows = found.orderBy("media_id", "frame_idx").collect()
    for name, y in (("long", wave), ("short", np.arange(700.0))):
        own = [r for r in rows if r["media_id"] == name]
        want = expected(y)
        assert [r["frame_idx"] for r in own] == list(range(len(want)))
        assert np.allclose(np.array([r["re"] for r in own]) + 1j * np.array([r["im"] for r in own]), want, atol=1e-9)


def test_back_to_samples(spark, samples, wave):
    found = G.istft(G.stft(samples, block=16), block=8).where("media_id = 'long'").orderBy("n").toPandas()
    assert found["n"].tolist() == list(range(len(wave) // 512 * 512))
    assert np.allclose(found["y"], wave[: len(found)], atol=1e-9)


def test_parts_rebuild_the_wave(spark, samples, wave):
    found = G.separated_wave(samples).where("media_id = 'long'").orderBy("n").toPandas()
    assert len(found) == len(wave) and np.allclose(found["harmonic"] + found["percussive"] + found["residual"], wave, atol=1e-9)
    assert abs(found["residual"]).max() < 1e-6  # with margins of 1 the masks sum to 1
    clicks, tone = np.arange(9000, 60_000, 9000), slice(20_000, 26_000)
    assert (found["percussive"].abs().to_numpy()[clicks] > found["harmonic"].abs().to_numpy()[clicks]).all()
    assert found["harmonic"][tone].std() > 3 * found["percussive"][tone].std()
    apart = G.separated_wave(samples, margin=(1.0, 5.0)).where("media_id = 'long'").toPandas()
    assert abs(apart["residual"]).max() > 0.01


def test_medians_by_hand(spark):
    mag = np.abs(np.random.default_rng(2).standard_normal((40, 9)))
    spectra = spark.createDataFrame([(0, t, mag[t].tolist(), [0.0] * 9) for t in range(40)], "media_id int, frame_idx int, re array<double>, im array<double>")
    found = G.separated(spectra, 5, (1.0, 2.0), block=7).where("part = 'percussive'").orderBy("frame_idx").collect()
    at = lambda k, n: k if 0 <= k < n else -k - 1 if k < 0 else 2 * n - 1 - k
    for t in range(40):
        for k in range(9):
            h = np.median([mag[at(t + d, 40), k] for d in range(-2, 3)])
            p = np.median([mag[t, at(k + d, 9)] for d in range(-2, 3)])
            assert found[t]["re"][k] == pytest.approx(mag[t, k] * p**2 / (p**2 + (2 * h) ** 2))


def test_bands_and_descriptors(spark, samples, wave):
    mags = G.magnitudes(G.stft(samples)).where("media_id = 'long'")
    want = np.abs(expected(wave))
    rows = G.mel(mags, SR, 2048, 40).orderBy("frame_idx").collect()
    weights = np.zeros((1025, 40))
    for k, band, w in T.mel_filters(SR, 2048, 40):
        weights[k, band] = w
    assert np.allclose(np.array([r["mel"] for r in rows]), want**2 @ weights)
    found = G.descriptors(mags, SR, 2048).orderBy("frame_idx").toPandas()
    hz = np.arange(1025) * SR / 2048
    centroid = (want * hz).sum(axis=1) / want.sum(axis=1)
    assert np.allclose(found["centroid"], centroid)
    assert np.allclose(found["bandwidth"], np.sqrt((want * (hz - centroid[:, None]) ** 2).sum(axis=1) / want.sum(axis=1)))
    assert np.allclose(found["rolloff"], [hz[np.flatnonzero(np.cumsum(row) >= 0.99 * row.sum())[0]] for row in want])
    chroma = np.array([r["chroma"] for r in G.chroma(mags, SR, 2048).collect()])
    assert (chroma.argmax(axis=1) == 9).mean() > 0.9  # A


def test_silence_and_nothing(spark):
    none = spark.createDataFrame([], "media_id int, n int, y double")
    assert G.stft(none).count() == 0 and G.separated_wave(none).count() == 0
    still = spark.createDataFrame([(0, k, None) for k in range(40)], "media_id int, n int, y double")
    mags = G.magnitudes(G.stft(still, 16, 4))
    assert {(r["centroid"], r["bandwidth"], r["rolloff"]) for r in G.descriptors(mags, 16.0, 16).collect()} == {(0.0, 0.0, 0.0)}
    assert all(x == 0.0 for r in G.chroma(mags, 16000.0, 16).collect() for x in r["chroma"])
    assert all(r["onset"] == 0.0 for r in G.onsets(G.decibels(G.mel(mags, 16000.0, 16, 4), "mel"), "mel").collect())
