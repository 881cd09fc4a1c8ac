"""Queries on spectra of real samples, with DuckDB SQL for the same rows; each user's events are a clip of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as G
from ..operators import spectra as T
from ..operators.stretch import stretched
from ..sources import adapters as A
from .registry import SIG, query, r, rounded

#: Window and step in samples, rate, medians and bands: small, so that SQL can follow them.
N, HOP, SR, KERNEL, BANDS = 16, 4, 16000.0, 7, 6
FT = f"""{SIG}, lens AS (SELECT media_id, max(n) + 1 AS len FROM sig GROUP BY 1),
fr AS (SELECT media_id, len // {HOP} + 1 AS frames, unnest(range(0, len // {HOP} + 1))::INT AS frame_idx FROM lens),
win AS (SELECT f.media_id, f.frame_idx, s.n - f.frame_idx * {HOP} + {N // 2} AS i, coalesce(s.y, 0) * (0.5 - 0.5 * cos(2 * pi() * (s.n - f.frame_idx * {HOP} + {N // 2}) / {N})) AS v FROM fr f JOIN sig s ON s.media_id = f.media_id AND s.n BETWEEN f.frame_idx * {HOP} - {N // 2} AND f.frame_idx * {HOP} + {N // 2 - 1}),
ft AS MATERIALIZED (SELECT media_id, frame_idx, k::INT AS k, sum(v * cos(2 * pi() * k * i / {N})) AS re, -sum(v * sin(2 * pi() * k * i / {N})) AS im FROM win, range({N // 2 + 1}) b(k) GROUP BY 1, 2, 3),
mags AS (SELECT *, sqrt(re * re + im * im) AS mag FROM ft)"""


def mirrored(at: str, size: str) -> str:
    """SQL of a place mirrored at both ends of 0 .. size - 1, the end itself first."""
    turn = f"((({at}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    return f"CASE WHEN {turn} < {size} THEN {turn} ELSE 2 * {size} - 1 - {turn} END"


def samples(s, d):
    return A.signal(s, d).select("media_id", "n", "y")


def spectra(s, d):
    return G.stft(samples(s, d), N, HOP)


def by_place(df, name, at):
    return df.select("media_id", "frame_idx", F.posexplode(name).alias(at, name))


@query(f"WITH {FT} SELECT media_id, frame_idx, k, {r('mag', 5)} AS mag FROM mags")
def stft_samples(s, d):
    return rounded(by_place(G.magnitudes(spectra(s, d)), "mag", "k"), 5)


@query(f"WITH {FT} SELECT s.media_id, s.n::BIGINT AS n, {r('coalesce(s.y, 0)', 5)} AS y FROM sig s JOIN lens l ON l.media_id = s.media_id WHERE s.n < l.len // {HOP} * {HOP}")
def istft_samples(s, d):
    """Samples to spectra and back, up to the centre of the last frame."""
    return rounded(G.istft(spectra(s, d), N, HOP), 5)


def _mask(a: str, b: str) -> str:
    most = f"greatest({a}, {b})"
    return f"CASE WHEN {most} < 1.1754944e-38 THEN 0.5 ELSE pow({a} / {most}, 2) / (pow({a} / {most}, 2) + pow({b} / {most}, 2)) END"


def _inverse(part: str) -> str:
    return f"sum(CASE WHEN k = 0 THEN re * {part} WHEN k = {N // 2} THEN re * {part} * cos(pi() * i) ELSE 2 * {part} * (re * cos(2 * pi() * k * i / {N}) - im * sin(2 * pi() * k * i / {N})) END) / {N} * (0.5 - 0.5 * cos(2 * pi() * i / {N}))"


@query(f"""WITH {FT},
h AS (SELECT f.media_id, f.frame_idx, m.k, median(m.mag) AS h FROM fr f CROSS JOIN range(-{KERNEL // 2}, {KERNEL // 2 + 1}) o(d) JOIN mags m ON m.media_id = f.media_id AND m.frame_idx = {mirrored('f.frame_idx + d', 'f.frames')} GROUP BY 1, 2, 3),
p AS (SELECT m.media_id, m.frame_idx, k.k, median(m.mag) AS p FROM range({N // 2 + 1}) k(k) CROSS JOIN range(-{KERNEL // 2}, {KERNEL // 2 + 1}) o(d) JOIN mags m ON m.k = {mirrored('k.k + d', str(N // 2 + 1))} GROUP BY 1, 2, 3),
masks AS (SELECT m.media_id, m.frame_idx, m.k, re, im, {_mask('h', 'p')} AS mh, {_mask('p', 'h')} AS mp FROM ft m JOIN h USING (media_id, frame_idx, k) JOIN p USING (media_id, frame_idx, k)),
waves AS (SELECT media_id, frame_idx * {HOP} - {N // 2} + i AS n, pow(0.5 - 0.5 * cos(2 * pi() * i / {N}), 2) AS w, {_inverse('mh')} AS h, {_inverse('mp')} AS p FROM masks, range({N}) t(i) GROUP BY media_id, frame_idx, i),
parts AS (SELECT media_id, n, sum(h) / sum(w) AS h, sum(p) / sum(w) AS p FROM waves GROUP BY 1, 2)
SELECT s.media_id, s.n::BIGINT AS n, {r('coalesce(s.y, 0)', 5)} AS y, {r('h', 5)} AS harmonic, {r('p', 5)} AS percussive, {r('coalesce(s.y, 0) - h - p', 5)} AS residual FROM sig s JOIN parts USING (media_id, n)""")
def hpss_wave(s, d):
    return rounded(G.separated_wave(samples(s, d), N, HOP, KERNEL), 5)


@query(f"""WITH {FT}, c AS (SELECT *, sum(mag) OVER f AS total, sum(mag) OVER (f ORDER BY k) AS cum, sum(k * {SR / N} * mag) OVER f / nullif(sum(mag) OVER f, 0) AS centroid FROM mags WINDOW f AS (PARTITION BY media_id, frame_idx))
SELECT media_id, frame_idx, {r('coalesce(first(centroid), 0)', 4)} AS centroid, {r(f"coalesce(sqrt(sum(mag * pow(k * {SR / N} - centroid, 2)) / nullif(first(total), 0)), 0)", 4)} AS bandwidth, {r('exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag))', 4)} AS flatness,
{r(f"count(*) FILTER (cum < 0.99 * total) * {SR / N}", 4)} AS rolloff, {r(f"count(*) FILTER (cum < 0.01 * total) * {SR / N}", 4)} AS rolloff_min FROM c GROUP BY 1, 2""")
def sampled_descriptors(s, d):
    return rounded(G.descriptors(G.magnitudes(spectra(s, d)), SR, N), 4)


def _weights(filters: list[tuple[int, int, float]]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {b}, {w!r}::DOUBLE)" for k, b, w in filters) + ") w(k, band, w)"


@query(f"""WITH {FT}, bands AS (SELECT media_id, frame_idx, band, sum(mag * mag * w) AS p FROM mags JOIN {_weights(T.mel_filters(SR, N, BANDS))} USING (k) GROUP BY 1, 2, 3),
db AS (SELECT media_id, frame_idx, band, greatest(10 * log10(greatest(p, 1e-10) / greatest(max(p) OVER (PARTITION BY media_id), 1e-10)), -80) AS db FROM bands),
rise AS (SELECT media_id, frame_idx, coalesce(greatest(db - lag(db) OVER (PARTITION BY media_id, band ORDER BY frame_idx), 0), 0) AS e FROM db)
SELECT media_id, frame_idx, {r('avg(e)', 4)} AS onset FROM rise GROUP BY 1, 2""")
def mel_onsets(s, d):
    bands = G.mel(G.magnitudes(spectra(s, d)), SR, N, BANDS)
    return rounded(G.onsets(G.decibels(bands, "mel"), "mel"), 4)


@query(f"""WITH {FT}, pitches AS (SELECT media_id, frame_idx, band AS pitch, sum(mag * mag * w) AS p FROM mags JOIN {_weights(G.chroma_filters(SR, N))} USING (k) GROUP BY 1, 2, 3)
SELECT media_id, frame_idx, pitch::INT AS pitch, {r('CASE WHEN max(p) OVER f > 1e-30 THEN p / max(p) OVER f ELSE 0 END', 5)} AS chroma FROM pitches WINDOW f AS (PARTITION BY media_id, frame_idx)""")
def sampled_chroma(s, d):
    return rounded(by_place(G.chroma(G.magnitudes(spectra(s, d)), SR, N), "chroma", "pitch"), 5)


@query()
def time_stretch(s, d):
    """Events at three quarters of their speed; tested on tones whose pitch stays."""
    return rounded(stretched(samples(s, d), 0.75, 16, 4), 5)
