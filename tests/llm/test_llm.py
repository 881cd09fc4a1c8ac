"""Operators of the pipeline against brute force, SQL and awkward rows."""

import collections
import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framelytics.llm import decontam, langid, licenses, lm, packing, quality, queries, simhash, tokens, toxicity, warc

LONG = "word " * 30000
TEXTS = [None, "", " ", "a", "The same text here.", "The same text here.", "one two three four five six seven eight nine ten eleven", "ÉCOLE à côté\n\n", "中文 <|endoftext|> ½ it's", "#*$ %%% |||", LONG]


OTHER_SCRIPTS = [
    "Старая библиотека была ЗАКРЫТА осенью, 1987 год.", "旧图书馆在秋天关闭了,城里的居民聚集在广场上。", "ΟΔΥΣΣΕΥΣ ὁ ἀνήρ", "नमस्ते दुनिया १२३", "مرحبا بالعالم ١٢", "İstanbul'da I'll 😀👩‍👩‍👧 ok🇫🇷",
    "a<|endoftext|>b <|endoftext|><|startoftext|> мир<|endoftext|>", "<|endoftext|>", "<|endoftext", "e\u0301<|endoftext|>\u0301 Å Ω", "\u3000全角\u3000 \u200b x\u2028y", "한국어 텍스트 ﬁ ﬀ ß ẞ",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, ["en", None][k % 2], k, "s", 5) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", 4, "s", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, id string, row int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "same text"), (3, None), (None, "a"), (5, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def docs(data):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", [n for n in queries.oracle_sql()])
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    want = c.execute(queries.oracle_sql()[name])
    at = [df.columns.index(x[0]) for x in want.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[k] for k in at) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_awkward_rows(spark, odd, labels, items):
    n = len(TEXTS) + 1
    empty = odd.limit(0)
    path = queries.tokenizer
    runs = [
        lambda d: toxicity.score(d, labels), langid.identify, simhash.near_duplicates, licenses.scan,
        lambda d: tokens.token_counts(d, path("word_bpe_49k.json")), lambda d: packing.pack_documents(d, path("byte_bpe_50k.json")).where("piece = 0"),
        quality.quality, lm.lm_scores, lambda d: decontam.decontaminate(d, items),
    ]
    for run in runs:
        found = run(odd).collect()
        assert len(found) == n and sum(r["doc_id"] is None for r in found) == 1
        assert run(empty).count() == 0
    assert decontam.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert {r["doc_id"] for r in langid.identify(odd).where("lang_pred = 'und'").collect()} >= {0, 1, 2}


def test_pages(spark):
    big = "x" * 200
    rows = [(1, None, big, 1), (2, "u\n", big, 1), (2, "v", big, 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", big, 1), (5, "u", "small", 1), (6, "u", "small", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    found = warc.round_trip(pages).collect()
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found) == collections.Counter([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (None, "revisit", 1), (5, "response", None), (6, "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0
    index = warc.write_archives(pages, warc.new_folder(spark, "t"))
    for row in index.collect():
        head, _ = warc.fetch(row)
        assert head["WARC-Record-ID"] == f"<{row['record_id']}>"


def test_equal_rows_have_records_of_their_own(spark):
    page = "z" * 300
    pages = spark.createDataFrame([(1, "u", page)] * 3 + [(2, None, page), (3, "w", page)], "page_id long, url string, html string")
    index = warc.write_archives(pages, warc.new_folder(spark, "t")).collect()
    assert len({r["record_id"] for r in index}) == 5
    heads = [warc.fetch(r)[0] for r in index]
    response = [h for h in heads if h["WARC-Type"] == "response"]
    assert len(response) == 1
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert h["WARC-Refers-To"] == response[0]["WARC-Record-ID"] and h["WARC-Refers-To-Target-URI"] == "u" and h["WARC-Refers-To-Date"]


def test_archives_are_read_in_many_tasks(spark, monkeypatch):
    pages = spark.range(8, numPartitions=8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), F.lit(50)).alias("html"))
    index = warc.write_archives(pages, warc.new_folder(spark, "t"))
    n = index.select("archive").distinct().count()
    assert n > 1 and warc.read_archives(index).rdd.getNumPartitions() == n


def test_tied_response(spark):
    pages = spark.createDataFrame([(1, "a", "y" * 150), (1, "b", "y" * 150)], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in warc.round_trip(pages).collect()) == ["response", "revisit"]


def test_fingerprints_and_components(spark, data, docs):
    def slow(text):
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0

    fps = {k: slow(t) for k, t in docs.items()}
    label = {k: k for k in fps}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    for r in queries.op3_simhash_near_dedup(spark, data).collect():
        assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == label[r["doc_id"]]


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(x)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    a, r, k = simhash.anchors(x)
    homes = set(zip(a[r == 0].tolist(), k[r == 0].tolist()))
    a, r, k = simhash.anchors(y)
    assert {q for p, q in zip(a[r == 1].tolist(), k[r == 1].tolist()) if (p, q) in homes} == set(range(3000))


def test_every_link_of_all_documents(spark):
    """At sf0.1: components equal those of all pairs of fingerprints within 4 bits."""
    found = queries.op3_simhash_near_dedup(spark, "/root/testdata/sf0.1").collect()
    fps = {int(r["fingerprint"], 16) for r in found}
    x, near = np.array(sorted(fps), np.uint64), []
    for k in range(0, len(x), 500):
        i, j = np.nonzero(np.bitwise_count(x[k : k + 500, None] ^ x[None, :]) <= 4)
        near += [(a + k, b) for a, b in zip(i.tolist(), j.tolist()) if a + k < b]
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in near:
        root[find(a)] = find(b)
    at, least = {f: k for k, f in enumerate(x.tolist())}, {}
    for r in found:
        k = find(at[int(r["fingerprint"], 16)])
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert near and all(r["component_id"] == least[find(at[int(r["fingerprint"], 16)])] for r in found)


def test_crowded_anchors_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))) for _ in range(600)})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    plain = {tuple(r) for r in simhash.components(simhash.links(table)).collect()}
    monkeypatch.setattr(simhash, "CELL_ROWS", 50)
    assert {tuple(r) for r in simhash.components(simhash.links(table)).collect()} == plain and len(plain) == len(fps) - 1


def test_tokens_are_the_librarys(spark, data, docs):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(queries.tokenizer(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    count = lambda t, x: len(t.encode(x, add_special_tokens=False).ids)
    for r in queries.op5_token_counts(spark, data).collect():
        assert r["n_tokens"] == count(word, docs[r["doc_id"]]) and r["n_bytes"] == len(docs[r["doc_id"]].encode())
    strange = [t or "" for t in TEXTS] + ["ǅ Ⱥ ʼn \x1c\x85\xa0 …“x”", "I'll  we're\n\n x ", "²½ 1234", "é", *OTHER_SCRIPTS]
    whole = tokens.proven_whole(queries.tokenizer("word_bpe_49k.json"))
    assert tokens.count_tokens(strange, queries.tokenizer("word_bpe_49k.json"), whole).tolist() == [count(word, x) for x in strange]
    for k, ids in tokens.encode(strange, queries.tokenizer("byte_bpe_50k.json")):
        assert bytes(ids) == tokens.packed(byte.encode(strange[k], add_special_tokens=False).ids)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op6_best_fit_packing(spark, data).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for k, text in docs.items():
        ids, at = [*byte.encode(text, add_special_tokens=False).ids, 2], 0
        for p, r in enumerate(sorted(pieces[k], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert r["piece"] == p and r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r["length"]
        assert at == len(ids)
        total += at
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(sequences) <= math.ceil(1.02 * total / 1024) + 1


def test_other_scripts_meet_the_shortcut():
    """Whole tokens of any script are proven, and texts of other scripts are looked up in them."""
    path = queries.tokenizer("word_bpe_49k.json")
    whole = tokens.proven_whole(path)
    assert any(not x.isascii() and tokens.UNUSUAL.search(x) for x in whole)
    one = next(x for x in sorted(whole) if tokens.UNUSUAL.search(x))
    _, known = tokens._counter(path, whole)
    known.give, give = lambda x: pytest.fail("merged") if x == one else give(x), known.give
    try:
        assert tokens.count_tokens([f"{one} {one}"], path, whole)[0] == 2
    finally:
        known.give = give


def test_language_model(spark, data, docs):
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    words = {k: ["<s>", *t.encode().lower().split(), None] for k, t in docs.items()}
    grams = [collections.Counter() for _ in range(3)]
    for k, w in words.items():
        if not held[k]:
            grams[0].update(w[1:])
            grams[1].update(zip(w, w[1:]))
            grams[2].update(zip(w, w[1:], w[2:]))
    n, v = sum(grams[0].values()), len(grams[0])
    context, kinds = collections.Counter(), collections.Counter()
    for level in grams[1:]:
        for g, c in level.items():
            context[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (grams[0][g[0]] + 0.1) / (n + 0.1 * (v + 1))
        own = g[:-1]
        return max(grams[len(g) - 1][g] - 0.75, 0) / context[own] + 0.75 * kinds[own] / context[own] * p(g[1:]) if context[own] else p(g[1:])

    fine = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.read.parquet(f"{data}/documents.parquet"), bits=16).collect()}
    for r in queries.op9_lm_scoring(spark, data).collect():
        w = words[r["doc_id"]]
        size = len(w) - 1
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], size, sum(grams[0][x] > 0 for x in w[1:]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p((x,))) for x in w[1:]))
        exact = sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w)))
        assert abs(fine[r["doc_id"]] - exact) < 1e-4 * size
        assert abs(r["score"] - exact) < 0.02 * size


def test_slices_within_a_context(spark, monkeypatch):
    """A context with most of the n-grams is cut into slices, which change no probability."""
    texts = [f"the w{k} x{k % 7}" for k in range(3000)] + ["a b"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    own = docs.select(F.col("text").cast("binary"))
    model = lm.build(own)
    firsts = [x[0] for x in model.levels[0].slices]
    the = model.words.numbers([b"the"])[0]
    assert sum(f // model.words.width == the for f in firsts) > 3
    assert model.levels[0].weights(np.array([the]))[0] == pytest.approx(0.75, rel=0.02)
    score = lm.log10_probabilities(model, [b"the w5 x5"])[3][0]
    monkeypatch.setattr(lm, "BOUND_SAMPLE", 0)
    assert score == pytest.approx(lm.log10_probabilities(lm.build(own), [b"the w5 x5"])[3][0], abs=0.1)


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").fetchall())
    found = queries.op2_language_id(spark, data).where("held_out").collect()
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.99
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    found = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.op1_toxicity(spark, data).where("held_out").collect() if r["doc_id"] in toxic]
    hits = sum(p and t for p, t in found)
    assert hits / sum(t for _, t in found) > 0.75 and hits / sum(p for p, _ in found) > 0.7


def test_shuffled_decontamination_is_the_same(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (decontam.decontaminate(docs, bench, literal_prints=n).drop("spans") for n in (20_000, 0))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_pipeline(spark, data):
    docs, before = spark.read.parquet(f"{data}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, docs, data), name)
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        before, docs = docs, kept
    assert decontam.decontaminate(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").count() == 0
    assert simhash.near_duplicates(before).where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()
