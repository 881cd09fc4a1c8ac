"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other text is unlabelled, not clean. A
linear classifier over words is trained in numpy on the risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
with logistic l: the second term is the risk on clean text, corrected by the class prior;
where a step finds it below zero, the step goes the other way, which keeps a flexible
model from fitting the positives alone. Every text that may be learned from is unlabelled
text of one classifier: classifiers are trained by tasks, each against a shard of bounded
size and all positives, and Spark averages their weights. Only the labelled positives are
a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

#: The bound of the labelled sample, drawn by a hash of the id, and unlabelled texts that a classifier is meant for.
POSITIVES, SHARD_TEXTS = 3000, 4000
STEPS, RATE, PENALTY = 300, 0.05, 1e-4
#: A feature is used if it is in more than so many positives, or no ratio could be told from chance, and surely so much likelier there.
LEAST_POSITIVES, LEAST_RATIO = 4, 0.7
#: Lengths of word beginnings that are features beside the words.
BEGINNINGS = (4, 5, 6, 7)
#: Words whose features a task remembers.
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen: many insults are inflected."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


class Lookup(dict):
    """The numbers of each word's features; features that aren't numbered have none."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.numbers[f] for f in features_of_word(word) if f in self.numbers)
        return found

    def of(self, text: str | None) -> list[int]:
        """The numbers of the features of a whole text, each once."""
        return list(set().union(*map(self.__getitem__, set(WORD.findall(text.lower()))))) if text else []


@dataclass(frozen=True)
class Model:
    """The logistic of the sum of a text's feature weights and the bias."""

    numbers: dict[str, int]
    weights: np.ndarray
    bias: float

    @cached_property
    def _lookup(self) -> Lookup:
        return Lookup(self.numbers)

    def score(self, text: str | None) -> float:
        margin = self.bias + float(self.weights[self._lookup.of(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def _flat(texts: list[bytes], scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of feature numbers (32-bit), one after the other: text, feature, and how large the feature is."""
    at = np.frombuffer(b"".join(texts), "<i4")
    return np.repeat(np.arange(len(texts)), [len(x) // 4 for x in texts]), at, scale[at].astype(np.float64)


def _train_one(positive: list[bytes], unlabelled: list[bytes], scale: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk over all given texts; only features that occur are touched."""
    n, m, size = len(positive), len(unlabelled), len(scale)
    (prow, pat, pval), (urow, uat, uval) = _flat(positive, scale), _flat(unlabelled, scale)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, STEPS + 1 if n and m else 0):
        gp, gu = np.bincount(prow, w[pat] * pval, n) + b, np.bincount(urow, w[uat] * uval, m) + b
        clean = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
        # slopes of l(-g) on both samples, and of l(g) on the positives
        up, uu = prior * sigmoid(gp) / n, sigmoid(gu) / m
        dp, du = (prior * (sigmoid(gp) - 1) / n - up, uu) if clean >= 0 else (up, -uu)
        slope = np.bincount(pat, dp[prow] * pval, size) + np.bincount(uat, du[urow] * uval, size) + PENALTY * w
        grad = np.append(slope, dp.sum() + du.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def _counted(texts: DataFrame, numbers, size: int) -> DataFrame:
    """(k, n): in how many of the texts each numbered feature is. numbers: a broadcast; a task sends one row per feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(numbers.value), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[lookup.of(text)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], names=["k", "n"])

    return texts.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def select_features(positive: DataFrame, unlabelled: DataFrame) -> list[tuple[str, float]]:
    """(feature, scale): what is in enough positives and likelier there than in all unlabelled texts; both have a column text.

    A feature is as large as the low end of its log ratio between positives and unlabelled texts.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [f for t in batch.column(0).to_pylist() for f in {f for w in set(WORD.findall((t or "").lower())) for f in features_of_word(w)}]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["w"])

    counts = positive.select("text").mapInArrow(found, "w string").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_POSITIVES)
    mine = {r["w"]: r["n"] for r in counts.collect()}  # at most the features of POSITIVES texts over LEAST_POSITIVES
    if not mine:
        return []
    names = sorted(mine)
    numbers = positive.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})
    m = np.full(len(names), 0.5)
    for r in _counted(unlabelled, numbers, len(names)).collect():
        m[r["k"]] += r["n"]
    n = np.array([mine[w] for w in names]) + 0.5
    ratio = np.log(n / (positive.count() + 1)) - np.log(m / (unlabelled.count() + 1)) - 1.64 * np.sqrt(1 / n + 1 / m)
    return [(w, float(r)) for w, r in zip(names, ratio) if r > LEAST_RATIO]


def train(positive: list[bytes], unlabelled: DataFrame, names: list[str], scale: np.ndarray, prior: float) -> Model:
    """positive: texts as feature numbers; unlabelled: a table (shard, x) of such. The mean of the shards' classifiers."""
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not names:
        return Model({}, np.zeros(0, np.float32), bias)
    shared = unlabelled.sparkSession.sparkContext.broadcast((positive, scale))

    def classifier(rows: pa.Table) -> pa.Table:
        positive, scale = shared.value
        w, b = _train_one(positive, sorted(rows.column("x").to_pylist()), scale, prior)
        return pa.table({"w": pa.array([np.append(w * scale, b)], pa.list_(pa.float64()))})

    found = unlabelled.groupBy("shard").applyInArrow(classifier, "w array<double>").select(F.posexplode("w").alias("k", "w")).groupBy("k").agg(F.avg("w").alias("w")).collect()
    weights = np.zeros(len(names) + 1)
    weights[-1] = bias
    for r in found:
        weights[r["k"]] = r["w"]
    return Model({w: k for k, w in enumerate(names)}, weights[:-1], float(weights[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, usable, positives: int = POSITIVES, shard_texts: int = SHARD_TEXTS) -> Model:
    """The prior is the share of toxic ones among all labelled, usable ids."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(usable(F.col("id")) & F.col("text").isNotNull())
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(usable(F.col("id")) & F.col("toxic").isNotNull())
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = float(np.clip(((counts["toxic"] or 0) + 1) / (counts["n"] + 2), 1e-3, 0.5))
    order = F.xxhash64("id")
    toxic = marks.where("toxic = 1").orderBy(order, "id").limit(positives).select("id")
    # The ids are bounded by a parameter, so texts are found by them in a map over the documents; an id that repeats does not lift the bound.
    chosen = staged(own.join(F.broadcast(toxic), "id").select("id", "text").orderBy(order, "id", F.xxhash64("text")).limit(positives).select("text"), "positives")
    features = select_features(chosen, own)
    names, scale = [w for w, _ in features], np.array([r for _, r in features], np.float32)
    numbers = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(numbers.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(sorted(lookup.of(x)), "<i4").tobytes() for x in batch.column(0).to_pylist()], pa.binary())], names=["x"])

    positive = sorted(r["x"] for r in chosen.mapInArrow(numbered, "x binary").collect())
    if not positive or not names:
        return train(positive, own, [], scale, prior)
    table = staged(own.select("text").mapInArrow(numbered, "x binary").withColumn("row", F.monotonically_increasing_id()), "unlabelled")
    shards = max(1, -(-table.count() // shard_texts))
    return train(positive, table.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "x"), names, scale, prior)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, positives: int = POSITIVES, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """Per row of docs: the id, held_out, score (0 to 1) and predicted (score >= 0.5).

    Learns from rows whose crc32(id as text) mod folds is not held, labels included. An id
    labelled twice is toxic if any label says so; null labels count as none. A null or
    empty text gets the score of a text without known words; a null id is neither learned
    from nor held out; repeated rows each get their row; with no positives every score is
    the prior. Other columns are ignored.
    """
    usable = lambda c: (fold(c, folds) >= 0) & (fold(c, folds) != held)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, usable, positives, shard_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["id", "held_out", "score"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), (fold(F.col(f"`{id_col}`"), folds) == held).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
