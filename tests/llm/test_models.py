"""The classifiers of toxicity and language against plain recomputation, and stages on awkward rows."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelytics.llm import decontam, langid, quality, simhash, toxicity


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")


def beginnings(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return {f for w in words for f in [w, *(w[:n] + "-" for n in (4, 5, 6, 7) if len(w) >= n)]}


def test_toxicity_scores_by_hand(spark, small):
    docs, labels = small
    every = lambda c: c.isNotNull()
    model = toxicity.fit(docs, labels, "doc_id", "text", every, shard_texts=60)
    assert model.numbers
    texts = [r["text"] for r in docs.collect()] + [None, "", "no such word zzz"]
    for text in texts:
        margin = model.bias + sum(model.weights[model.numbers[f]] for f in beginnings(text) if f in model.numbers)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-margin)))


def test_toxicity_features_by_hand(spark, small):
    docs, labels = small
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("text IS NOT NULL").collect()}
    n, m = collections.Counter(), collections.Counter()
    for k, text in texts.items():
        m.update(beginnings(text))
        if k in toxic:
            n.update(beginnings(text))
    size = len(toxic & set(texts))
    ratio = {f: math.log((n[f] + 0.5) / (size + 1)) - math.log((m[f] + 0.5) / (len(texts) + 1)) - 1.64 * math.sqrt(1 / (n[f] + 0.5) + 1 / (m[f] + 0.5)) for f in n if n[f] > 4}
    positive = docs.where(F.col("doc_id").isin(list(toxic)) & F.col("text").isNotNull())
    assert dict(toxicity.select_features(positive, docs.where("text IS NOT NULL"))) == pytest.approx({f: r for f, r in ratio.items() if r > 0.7})


def test_shards_are_averaged(spark):
    x = [np.array(k, "<i4").tobytes() for k in ([0], [0, 1], [1], [])]
    table = spark.createDataFrame([(k % 2, bytearray(x[k % 4])) for k in range(40)], "shard long, x binary")
    scale = np.ones(2, np.float32)
    found = toxicity.train([x[0]] * 5, table, ["a", "b"], scale, 0.2)
    parts = [toxicity._train_one([x[0]] * 5, sorted(x[k % 4] for k in range(40) if k % 2 == s), scale, 0.2) for s in (0, 1)]
    assert found.weights == pytest.approx((parts[0][0] + parts[1][0]) / 2) and found.bias == pytest.approx((parts[0][1] + parts[1][1]) / 2)


def test_risk_is_as_by_hand():
    """The slope of the first step is that of the corrected risk, and a negative clean risk turns it round."""
    scale, x = np.array([1.0, 2.0], np.float32), [np.array(k, "<i4").tobytes() for k in ([0], [1], [0, 1], [])]
    positive, unlabelled = np.array([[1, 0], [1, 2.0]]), np.array([[0, 2.0], [0, 0], [1, 0]])

    def risk(w, b, prior):
        gp, gu = positive @ w + b, unlabelled @ w + b
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return prior * np.logaddexp(0, -gp).mean() + clean if clean >= 0 else -clean

    for prior in (0.1, 0.95):
        b0 = math.log(prior / (1 - prior))
        slope = np.array([(risk(np.eye(2)[k] * 1e-6, b0, prior) - risk(-np.eye(2)[k] * 1e-6, b0, prior)) / 2e-6 for k in range(2)])
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "STEPS", 1)
            w, _ = toxicity._train_one([x[0], x[2]], [x[1], x[3], x[0]], scale, prior)
        assert (np.sign(w) == -np.sign(slope)).all()


def test_repeated_labels_do_not_lift_the_bound(spark):
    docs = spark.createDataFrame([(1, f"bad text {k}") for k in range(50)] + [(2, "good text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, "doc_id", "text", lambda c: c.isNotNull(), positives=10).numbers is not None
    assert {r["predicted"] for r in toxicity.score(docs, labels).collect()} <= {0, 1}


def grams(text):
    """Counts of hashed letter n-grams per order, letter by letter."""
    codes, last = [], None
    for c in text + "\n":
        low = ord(c.lower()[0]) if c.isalpha() else 0
        if low or last != 0:
            codes.append(low)
        last = low
    out = []
    for n in (1, 2, 3):
        found = collections.Counter()
        for k in range(len(codes) - n + 1):
            h = 0
            for c in codes[k : k + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 & 0xFFFFFFFF)
            if codes[k + n - 1] or n > 1:
                found[((h ^ (n * 0x05EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35 & 0xFFFFFFFF) >> 20] += 1
        out.append(found)
    return out


def test_language_scores_by_hand(spark, small):
    docs, _ = small
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(40).collect()]
    for text, margins, (lang, score) in zip(texts, model.margins(texts), model.predict(texts)):
        counted = [(c, sum(c.values())) for c in grams(text)]
        want = [b + sum(w[g] * n / total for c, total in counted if total for g, n in c.items()) for w, b in zip(model.weights, model.bias)]
        assert margins == pytest.approx(want, abs=1e-5)
        duel = dict(zip(model.pairs, want))
        side = lambda names: max(names, key=lambda x: (sum((m if a == x else -m) > 0 for (a, b), m in duel.items() if x in (a, b) and {a, b} <= set(names)), sum(m if a == x else -m for (a, b), m in duel.items() if x in (a, b) and {a, b} <= set(names))))
        kin = side(["family " + f for f in model.families]) if len(model.families) > 1 else "family " + model.families[0]
        own = [x for x in model.langs if "family " + langid.family(x) == kin]
        assert lang == (side(own) if len(own) > 1 else own[0]) and 0 <= score <= 1


def test_copies_do_not_fill_a_sample(spark, monkeypatch):
    rows = [("aaaa bbbb cccc", "en")] * 1500 + [(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} text", "en") for k in range(1000)] + [("eins zwei drei", "de")]
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, langs: seen.append(len(np.unique(x[np.array(langs) == "en"], axis=0))))
    langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=500)
    assert seen[0] > 400


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as the stages name theirs."""
    prose = " ".join(f"word{k} and some more of it" for k in range(400))
    rows = [(1, prose, "en"), (1, prose, "en"), (None, prose, None), (2, None, "en"), (3, "", None), (4, " ".join(f"t{k}" for k in range(60000)), "en"), (5, "one two three four five six seven eight nine ten eleven", "en"), (None, None, None)]
    names = ["lang_found", "score_found", "row", "late", "_row", "_lang", "_score", "text_", "words", "kept", "h", "fp"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def test_stages_on_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (None, "x"), (2, None)], "item_id long, text string")
    runs = {"good": quality.keep_good, "recognised": langid.keep_recognised, "first": simhash.keep_first, "clean": lambda d: decontam.clean_only(d, items)}
    for name, run in runs.items():
        kept = run(awkward)
        assert kept.columns == awkward.columns and kept.exceptAll(awkward).count() == 0, name
        found = sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect() if r["doc_id"] is not None)
        nulls = sum(r["doc_id"] is None for r in kept.collect())
        if name == "first":  # one row of the equal texts, one of the texts without words
            assert [k for k, _ in found] == [1, 2, 4, 5] and nulls == 0
        if name == "clean":
            assert [k for k, _ in found] == [1, 1, 2, 3, 4] and nulls == 2
        if name == "good":
            assert not {2, 3} & {k for k, _ in found}
        if name == "recognised":
            assert not {2, 3} & {k for k, _ in found}
        empty = run(awkward.limit(0))
        assert empty.count() == 0 and empty.columns == awkward.columns
