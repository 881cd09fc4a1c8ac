"""What the check of round 3 asked about."""

import numpy as np

from framelytics.llm import lm


def test_set_and_clear_bits_are_found_by_rank():
    random = np.random.default_rng(1)
    for share in (0.01, 0.5, 0.99):
        flags = (random.random(64 * 300) < share).astype(np.uint8)
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        for flip in (False, True):
            each = np.bitwise_count(~words if flip else words).astype(np.int64)
            places = np.flatnonzero(flags != flip)
            assert np.array_equal(lm._select(words, np.cumsum(each) - each, np.arange(len(places)), flip), places)


def test_different_tokens_come_from_the_different_words():
    words = [b"a", b"b", b"\xc3\xa9"]

    class Numbered:
        size = len(words)

        def numbers(self, found):
            return np.array([words.index(x) if x in words else -1 for x in found], np.int64)

    token, first, n, own, at = lm.tokens_of(Numbered(), [b"B x \xc3\xa9 b y", b"", b"a a"])
    assert token.tolist() == [1, -1, 2, 1, -1, 3, 3, 0, 0, 3] and np.flatnonzero(first).tolist() == [0, 6, 7] and n.tolist() == [6, 1, 3]
    assert own.tolist() == [-1, 0, 1, 2, 3] and np.array_equal(own[at], token)
    keys, counts = lm.counted(np.array([7, 3, 7, 7], np.uint64))
    assert keys.tolist() == [3, 7] and counts.tolist() == [1, 3]


def test_a_carried_text_is_sent_once_and_parts_join(spark, monkeypatch):
    """Parts of few rows and few characters give what one part gives; texts that are null or empty keep their place."""
    from pyspark.sql import functions as F

    from framelytics.llm import langid

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 3, None).when(F.col("id") % 7 == 5, "").otherwise(F.concat(F.lit("the house of "), F.repeat(F.lit("word "), (F.col("id") % 5 + 1).cast("int")), F.when(F.col("id") % 2 == 0, "und der hund ist gut").otherwise("and the dog is good"))).alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    whole = sorted(map(tuple, langid.identify(docs).collect()))
    kept = sorted(map(tuple, langid.keep_recognised(docs).collect()))
    model = langid.fit(docs)
    sent = langid.predicted(docs, model, "text", docs.columns, ("l", "s"))
    assert "whole" not in sent._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(langid, "ROWS", 4)
    monkeypatch.setattr(langid, "CHARACTERS", 30)
    assert sorted(map(tuple, langid.identify(docs).collect())) == whole
    assert sorted(map(tuple, langid.keep_recognised(docs).collect())) == kept


def test_encoding_in_parts_and_odd_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from framelytics.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "it's 12 34  x\n", "café × ÷  µ", " 中文 <|endoftext|>", "plain text", "— dash ǅ ɏ", "a_b  -- \t!"] * 3
    library = Tokenizer.from_file(path)
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(tokens, "SLICE", 12)
    found = dict(tokens.encode(texts, path))
    assert [np.frombuffer(bytes(found[k]), "<u4").tolist() for k in range(len(texts))] == want
    assert [tokens.odd(x.encode()) for x in ("plain", "it's", "é", "×", "÷", "µ", "—", "ɏ", "ʰ")] == [False, True, False, True, True, True, False, False, True]


def test_texts_to_pack_are_sent_in_small_batches(spark, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import functions as F

    from framelytics.llm import packing
    from framelytics.llm.common import BATCH_ROWS, staged

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(BATCH_ROWS)
    found = [r.n for r in staged(spark.range(0, 25, 1, 1).mapInArrow(sizes, "n long"), "sizes", 10).collect()]
    assert sum(found) == 25 and max(found) <= 10 and spark.conf.get(BATCH_ROWS) == before

    asked = {}
    monkeypatch.setattr(packing, "staged", lambda df, name, *rows: asked.setdefault(name, rows) and None or staged(df, name, *rows))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("it's word "), "id").alias("text"))
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.where("piece = 0").count() == 3000 and asked["pieces"] == (packing.ROWS,) and packing.ROWS <= 1000


def test_texts_are_exploded_in_small_parts(spark, monkeypatch):
    """op12: texts reach Python some bytes at a time, a longer text is cut at its breaks, and what is counted stays the same."""
    from collections import Counter
    from types import SimpleNamespace

    import pyarrow as pa

    from framelytics.llm import phrases
    from framelytics.llm.common import BATCH_BYTES

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([x for _, _, x in rows], pa.string()), pa.array([x for _, x, _ in rows], pa.string())], names=["lang", "text"])

    sizes = [part.own.size for part in phrases.parts([batch([(0, "two words. " * 300_000, "en"), (1, "x y", "en")])])]
    assert sum(sizes) == 600_002 and max(sizes) <= 1_200_000 // 5

    every = SimpleNamespace(value=SimpleNamespace(passes=lambda keys: np.ones(len(keys), bool)))
    steps = [lambda docs: phrases.exploded_words(docs), lambda docs: phrases.exploded_pairs(docs, every), lambda docs: phrases.exploded_phrases(docs, 5, every)]

    def counts(rows):
        """Of each step; by what it returns, in this process."""
        out = []
        for step in steps:
            found = Counter()
            for b in step(SimpleNamespace(mapInArrow=lambda run, schema: run))([batch(rows)]):
                for *key, f in zip(*(column.to_pylist() for column in b.columns), strict=True):
                    found[tuple(key)] += f
            out.append(found)
        return out

    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "ü", "d.", "e,\n", "F "], 300).tolist()), ["en", "und"][k % 2]) for k in range(60)] + [(60, "no break here " * 90, "en"), (61, "", "de"), (62, ".", "de"), (63, "..a b", "de")]
    whole = counts(rows)
    assert len(whole[2]) > 100
    for part in (1, 50, 700):
        monkeypatch.setattr(phrases, "PART", part)
        assert counts(rows) == whole
    monkeypatch.undo()

    docs = spark.createDataFrame([*rows, (64, None, None)], "doc_id long, text string, lang string")
    before = spark.conf.get(BATCH_BYTES, None)
    found, asked, exploded = [], [], phrases.exploded_phrases
    monkeypatch.setattr(phrases, "exploded_phrases", lambda *a: asked.append(spark.conf.get(BATCH_BYTES)) or exploded(*a))
    for sent in (1, 900_000):
        monkeypatch.setattr(phrases, "SENT", sent)
        found.append(sorted(map(tuple, phrases.collocations(docs, min_count=20).collect())))
    assert found[0] == found[1] and len(found[0]) > 20 and asked == ["1", "900000"] and spark.conf.get(BATCH_BYTES, None) == before
