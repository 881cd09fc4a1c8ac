"""Language identification in two steps: family, then one against one within it.

Texts become relative frequencies of hashed letter n-grams. A linear support vector
machine per pair of families votes for the family, then one per pair of its languages
for the language. All machines are linear in the frequencies, so a text of any length is
scored by adding up the weights of its n-grams; machines are trained by numpy on a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, free_name

UNKNOWN = "und"
#: Language families by code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
}
BUCKETS, ORDERS = 4096, (1, 2, 3)
#: The bounds of the labelled sample: different texts of each language, texts in all, and languages, those of most texts first.
PER_LANGUAGE, IN_ALL, LANGUAGES = 1000, 20_000, 200
EPOCHS, PENALTY = 30, 1e-4
#: Rows, and about how many characters of their texts, that are scored at once.
ROWS, CHARACTERS = 1000, 500_000
#: Scores are logistic in the margin times this.
STEEPNESS = 4.0
#: A text is unfamiliar if it is further from its language's held-out texts than this share of the way to random n-grams,
#: and further than all but this share of those texts.
STRETCH, STRAY = 0.25, 0.01
#: Held-out texts from which a bound is set; a language with fewer has none.
LEAST_HELD = 5


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def _lowered() -> np.ndarray:
    """Of each code point of the basic plane its lower case, or 0 if it's no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(k)).isalpha() else 0 for k in range(0x10000)], np.uint32)


_LETTERS: list[np.ndarray] = []


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the bucket of every n-gram of all texts, the text of each, and nothing across texts.

    Letters are taken in lower case; all else is one separator. Letters beyond the basic
    plane count by their code.
    """
    if not _LETTERS:
        _LETTERS.append(_lowered())
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    which = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.concatenate([[0], ends])))
    low = np.where(codes < 0x10000, _LETTERS[0][np.minimum(codes, 0xFFFF)], codes)
    stay = np.ones(len(low), bool)
    stay[1:] = (low[1:] != 0) | (low[:-1] != 0) | (which[1:] != which[:-1])  # one separator for many
    low, which = low[stay], which[stay]
    hashed = np.zeros(len(low), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        hashed = (hashed[: len(low) - n + 1] * np.uint32(0x01000193)) ^ (low[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            same = (which[n - 1 :] == which[: len(low) - n + 1]) & ((low[n - 1 :] != 0) | (n > 1))
            yield (hashed[same] ^ np.uint32(n * 0x05EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(20), which[n - 1 :][same]


def features(texts: list[str]) -> np.ndarray:
    """Frequencies of the n-grams of each text, len(texts) x BUCKETS; each order adds up to 1."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for buckets, which in _grams(texts):
        counts = np.bincount(which.astype(np.int64) * BUCKETS + buckets, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        out += counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return out


@dataclass(frozen=True)
class Model:
    """Machines: a row of weights and a bias each. pairs[k] names the two sides of machine k; positive margins are for the first.

    logs and bounds are by language: log frequencies of the n-grams, and the least familiarity of a recognised text.
    """

    langs: tuple[str, ...]
    families: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    bias: np.ndarray
    logs: np.ndarray
    bounds: np.ndarray

    def familiar(self, texts: list[str], found: list[str]) -> np.ndarray:
        """Of each text, if its n-grams are as usual in the language found for it as the bound asks. All of an unlisted language are not."""
        at = np.array([self.langs.index(x) if x in self.langs else -1 for x in found], np.int64)
        total = np.zeros(len(texts))
        for buckets, which in _grams(texts) if self.langs else ():
            n = np.maximum(np.bincount(which, minlength=len(texts)), 1)
            total += np.bincount(which, self.logs[at[which], buckets], minlength=len(texts)) / n
        return (at >= 0) & (total >= np.append(self.bounds, np.inf)[at])

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        for buckets, which in _grams(texts):
            n = np.maximum(np.bincount(which, minlength=len(texts)), 1)
            for k in range(len(self.pairs)):
                out[:, k] += np.bincount(which, self.weights[k][buckets], minlength=len(texts)) / n
        return out

    def vote(self, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most duels won, then the largest sum of margins; and how sure."""
        if len(names) == 1:
            return names[0], 1.0
        found = {}
        for name in names:
            own = [m if a == name else -m for (a, b), m in zip(self.pairs, margins) if name in (a, b) and {a, b} <= set(names)]
            found[name] = (sum(m > 0 for m in own), sum(own), min(own))
        best = max(names, key=lambda x: found[x][:2])
        return best, float(1 / (1 + np.exp(-np.clip(STEEPNESS * found[best][2], -30, 30))))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for margins in self.margins(texts):
            kin, sure = self.vote(["family " + f for f in self.families], margins)
            lang, surer = self.vote([x for x in self.langs if "family " + family(x) == kin], margins)
            out.append((lang, sure * surer))
        return out


def _machine(pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear SVM: squared hinge loss, both classes of equal weight, by accelerated full-batch descent. Neither array is copied."""
    w, b = np.zeros(pos.shape[1], np.float32), np.float32(0)
    longest = max((float(np.einsum("ij,ij->i", x, x).max()) for x in (pos, neg) if len(x)), default=0.0)
    step = 0.5 / (longest + 1 + PENALTY)
    v, c, t = w, b, 1.0
    for _ in range(EPOCHS * 10):
        above = (np.maximum(0, 1 - (pos @ v + c)) * (0.5 / max(1, len(pos)))).astype(np.float32)
        below = (np.maximum(0, 1 + (neg @ v + c)) * (0.5 / max(1, len(neg)))).astype(np.float32)
        w2, b2 = v + 2 * step * (above @ pos - below @ neg) - step * PENALTY * v, c + 2 * step * (above.sum() - below.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, t = (w2 + (t - 1) / t2 * (w2 - w)).astype(np.float32), np.float32(b2 + (t - 1) / t2 * (b2 - b)), t2
        w, b = w2.astype(np.float32), np.float32(b2)
    return w, float(b)


def _usual(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Of one language's features: log frequencies from every other text, and the bound from the texts between."""
    logs = np.log(x[::2].mean(axis=0) / len(ORDERS) + 1e-6)
    held = x[1::2] @ logs
    if len(held) < LEAST_HELD:
        return logs, -np.inf
    middle, chance = np.median(held), len(ORDERS) * logs.mean()
    return logs, float(min(middle - STRETCH * (middle - chance), np.quantile(held, STRAY)))


def train(x: np.ndarray, langs: list[str]) -> Model:
    """x: features of the training texts, in the order of (family, language); they are scaled in place.

    Features are scaled by their spread, which goes into the weights. In this order the
    texts of a language, and those of a family, are a slice of x.
    """
    names = sorted(set(langs))
    kin = sorted({family(a) for a in names})
    own, labels = np.array(langs), np.array(["family " + family(a) for a in langs])

    def rows(name: str) -> np.ndarray:
        at = np.flatnonzero((labels if name.startswith("family ") else own) == name)
        return x[at[0] : at[-1] + 1]

    usual = [_usual(rows(a)) for a in names]
    spread = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32) if len(x) else np.ones(BUCKETS, np.float32)
    x *= spread

    pairs = [("family " + a, "family " + b) for a, b in combinations(kin, 2)] + [(a, b) for a, b in combinations(names, 2) if family(a) == family(b)]
    weights, bias = np.zeros((len(pairs), BUCKETS)), np.zeros(len(pairs))
    for k, (a, b) in enumerate(pairs):
        w, bias[k] = _machine(rows(a), rows(b))
        weights[k] = w * spread
    logs = np.array([a for a, _ in usual]) if usual else np.zeros((0, BUCKETS), np.float32)
    return Model(tuple(names), tuple(kin), tuple(pairs), weights, bias, logs, np.array([b for _, b in usual]))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Trained on at most per_language different texts of each label; texts without a letter are left out.

    Texts are drawn by a hash; however often a text is repeated, it is one of them.
    """
    labelled = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return train(np.zeros((0, BUCKETS), np.float32), [])
    per_language = min(per_language, IN_ALL // len(counts))
    # Twice as many as asked for, as the counts are estimates; at most LANGUAGES literals.
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], float(2 * per_language / max(1, r["n"])))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    drawn = labelled.where(chance < F.element_at(shares, F.col("lang"))).groupBy("lang", F.xxhash64("text").alias("k")).agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                some = features(texts[at : at + 200])
                yield pa.RecordBatch.from_arrays([pa.array(langs[at : at + 200]), pa.array([x.astype(np.float16).tobytes() for x in some], pa.binary())], names=["lang", "x"])

    ranked = drawn.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("k")).alias("r")).where(F.col("r") <= per_language)
    rows = ranked.select("text", "lang").mapInArrow(vectors, "lang string, x binary").collect()
    rows = sorted((r for r in rows if any(r["x"])), key=lambda r: (family(r["lang"]), r["lang"], bytes(r["x"])))
    x = np.empty((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r["x"], np.float16)
    langs = [r["lang"] for r in rows]
    del rows
    return train(x, langs)


def predicted(docs: DataFrame, model: Model, text_col: str, carry: list[str], names: tuple[str, str], strict: bool = False) -> DataFrame:
    """The columns to carry, then language and score by these names. If strict, an unfamiliar text gets `und` and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(*[F.col(f"`{c}`") for c in carry])
    # A text that is carried anyway goes to Python once.
    place = carry.index(text_col) if text_col in carry else len(carry)
    sent = taken if text_col in carry else docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias(free_name(taken, "whole")))

    def told(texts: list[str]) -> list[tuple[str, float]]:
        found = shared.value.predict(texts)
        known = shared.value.familiar(texts, [x for x, _ in found]) if strict else [True] * len(texts)
        return [p if ok and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t, p, ok in zip(texts, found, known)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            for at in range(0, batch.num_rows, ROWS):
                part, size = [], 0
                for text in batch.column(place).slice(at, ROWS).to_pylist():
                    part.append(text or "")
                    size += len(part[-1])
                    if size > CHARACTERS:
                        found += told(part)
                        part, size = [], 0
                found += told(part) if part else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*batch.schema.names[: len(carry)], *names])

    schema = T.StructType([*taken.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return sent.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of docs: the id, held_out, lang_pred and score (0 to 1).

    Learns from rows with a label whose crc32(id as text) mod folds is not held. A text
    without a letter, a null text, or any text when nothing could be learned gets `und`
    and score 0. A null id is neither learned from nor held out. Ties of votes go to the
    larger sum of margins, then to the first name. Other columns are ignored.
    """
    at = fold(F.col(f"`{id_col}`"), folds)
    model = fit(docs.where((at >= 0) & (at != held)), text_col, lang_col, per_language)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (at == held).alias("held_out"))
    found = predicted(slim, model, "text", ["id", "held_out"], ("lang_pred", "score"))
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_recognised(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised: not `und`, with a score of at least `least`.

    The score says which language is nearest; texts in none of the languages are told by n-grams that are unusual in
    the nearest one.
    """
    model = fit(docs, text_col, lang_col, per_language)
    lang, score = free_name(docs, "lang_found"), free_name(docs, "score_found")
    found = predicted(docs, model, text_col, docs.columns, (lang, score), strict=True)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select([F.col(f"`{c}`") for c in docs.columns])
