"""Byte-level BPE, phrase collocations and ranked search by brute force and on awkward rows; licences and prints that round 2 got wrong."""

import base64
import hashlib
import heapq
import math
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from framelytics.llm import bpe, decontam, licenses, phrases, queries, search, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


AWKWARD = ["", None, " ", "\n\n  \n", "a", "I'm can't IT'S ½ ² ٣ 漢字かな　x y", "<|endoftext|> text", "é́ ÀÈ × ÷ ñ\xa0\x85z", "🙂🙂 a🙂", "ab" * 30_000, "x" * 50_000, "word " * 40_000, "\x00\x01\x1c \x1d"]


def test_op11_equals_the_library(spark, library):
    rng = random.Random(0)
    letters = "aaabcde eth THE'sé  \n\t1234,.;—漢字ñ"
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 60, 2000]))) for _ in range(150)]
    rows = [(k % 140, x, None) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "null id", "en")], DOCS).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    found = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=repr)
    want = []
    for k, text, _ in rows + rows[:3] + [(None, "null id", "en")]:
        ids = library.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_op11_query(spark, data, library):
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert found[doc_id] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_a_lower_rank_that_comes_late():
    """Of a made-up vocabulary: once "bx" has merged, "bxy" outranks it, so the order within the word decides."""
    tokens = [bytes([b]) for b in range(256)] + [b"xy", b"bxyz", b"bx", b"yz", b"bxy"]
    pairs = bpe.Pairs({t: k for k, t in enumerate(tokens)})

    def direct(word):
        parts = [word[k : k + 1] for k in range(len(word))]
        while True:
            ranked = [(tokens.index(a + b), k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
            if not ranked:
                return [tokens.index(p) for p in parts]
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(1)
    words = list({bytes(rng.choice(b"bxyz") for _ in range(rng.randint(1, 12))) for _ in range(500)})
    assert bpe.replay(words, pairs) == [packed(direct(w)) for w in words]
    assert [bpe.merged_alone(w, pairs) for w in words] == [packed(direct(w)) for w in words]
    assert bpe.replay([], pairs) == []


def test_op11_decode(spark):
    df = spark.createDataFrame([(packed([15496, 995]), "kept"), (b"", None), (None, "x")], "ids binary, decoded string")
    rows = bpe.decode(df, PATH).collect()
    assert [bytes(r["decoded_"]) for r in rows] == [b"Hello world", b"", b""] and rows[0]["decoded"] == "kept"
    with pytest.raises(Exception, match="stands for no token"):
        bpe.decode(spark.createDataFrame([(packed([60_000]),)], "ids binary"), PATH).collect()


def collocations(rows, max_n=5, least=100, share=100, top=2000):
    """By plain counting, in Python's whole numbers."""
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.setdefault((lang, k), Counter()).update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        long = {p: a for k in range(2, max_n + 1) for p, a in f[lang, k].items() if a >= least}
        scored = []
        for p, a in long.items():
            words = p.split(" ")
            if any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= share * a for q, b in long.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                l, r = f[lang, k][" ".join(words[:k])], f[lang, len(words) - k][" ".join(words[k:])]
                cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            scored.append((-score, -a, p.encode(), p, l, r))
        out += [(lang, i + 1, p, -a, l, r, n[lang], -s) for i, (s, a, _, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_op12_by_counting(spark):
    rng = random.Random(2)
    words = ["The", "the", "a", "é", "zebra", "漢", "of-x", "b\x00c", "Q"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "\r", ": "]) for _ in range(rng.randint(0, 200))), rng.choice(["en", "fr", None])) for k in range(150)]
    rows += [(k, "one two three four five six. seven", "en") for k in range(40)] + [(1, None, "en"), (None, "", "xx"), (2, "x " * 5000, "de"), (3, " \t,.", "ru")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("p")).withColumn("f", F.lit(1))
    for max_n, least, share, top in ((5, 20, 100, 2000), (5, 30, 60, 7), (2, 5, 100, 50), (3, 40, 90, 1000)):
        found = phrases.collocations(docs, max_n, least, share, top)
        assert sorted(map(tuple, found.collect())) == collocations(rows, max_n, least, share, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_op12_pieces_of_tasks_and_long_products(spark):
    texts = [(k, "alpha beta gamma, delta", "en") for k in range(500)]
    found = {r["phrase"]: r for r in phrases.collocations(spark.createDataFrame(texts, DOCS).repartition(7)).collect()}
    assert set(found) == {"alpha beta gamma"} and found["alpha beta gamma"]["a"] == 500 and found["alpha beta gamma"]["score"] == 1000 * 500 * 2000 // (500 * 500)
    a, n, l, r = 3 * 10**12 + 1, 7 * 10**13 + 3, 3 * 10**12 + 5, 3 * 10**12 + 7
    row = spark.createDataFrame([(Decimal(1000 * a * n), Decimal(l * r))], "above decimal(38,0), below decimal(38,0)").select(F.expr("above div below")).first()
    assert row[0] == 1000 * a * n // (l * r) and 1000 * a * n > 2**64


def ranked(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [term.findall((t or "").translate(LOW)) for _, t, _ in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _, _), words in zip(docs, terms):
            tf, m, score = Counter(words), 10 + 90 * len(words) * n_docs // max(1, total), 0
            for t in set(term.findall((text or "").translate(LOW))):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(heapq.nsmallest(k, scored))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows, sorted_keys", [(2_000_000, 4_000_000), (20, 7)])
def test_op13_by_loop(spark, monkeypatch, block_rows, sorted_keys):
    monkeypatch.setattr(search, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(search, "SORTED", sorted_keys)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "漢字", "THE", "the"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] + rng.choice(["", ".", "-", "\x00"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60)), None) for k in range(300)]
    docs += [(k, docs[5][1], None) for k in range(1000, 1030)] + [(1, docs[7][1], None), (None, docs[5][1], None), (2000, None, None), (2001, "  ,, ", None), (2002, "w1 " * 20_000, None)]
    items = [(k, text(12)) for k in range(15)] + [(3, docs[5][1]), (3, docs[5][1]), (None, "w2 w3"), (50, None), (51, "nowhere at all"), (52, ""), (53, "w1 W1 w1")]
    found = search.search(spark.createDataFrame(docs, DOCS).withColumn("item", F.lit(1)).withColumn("score", F.lit(2)).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("t")))
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, items)


def test_op13_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b", None)], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.withColumn("doc_id", F.lit("x")), items).first()["doc_id"] == "x"


def test_radix_order():
    rng = np.random.default_rng(0)
    for most in (1, 2**16 - 1, 2**20, 2**40):
        keys = rng.integers(0, most + 1, 5000)
        assert (search.by_radix(keys) == np.argsort(keys, kind="stable")).all()
    assert len(search.by_radix(np.zeros(0, np.int64))) == 0


BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//    * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
//    * Neither the name of {} nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission.
"""
LICENCES = [
    (BSD.format("Google Inc."), "BSD-3-Clause", ""),
    (BSD.format("the Foo Bar Project, Ltd."), "BSD-3-Clause", ""),
    ("This code is not licensed under the MIT License.", "", ""),
    ("It was never, in any form, released under the GPL v3", "", ""),
    ("nothing here is released under the GPL v3", "", ""),
    ("This is not a toy. It is licensed under the MIT License by us.", "MIT", ""),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT,Apache-2.0", ""),
    ("Licensed under either of\n\n * Apache License, Version 2.0 (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license (LICENSE-MIT or http://opensource.org/licenses/MIT)\n\nat your option.", "MIT,Apache-2.0", ""),
    ("All photos are under CC BY-SA 3.0.", "CC-BY-SA-3.0", ""),
    ("The text is available under the Creative Commons Attribution-ShareAlike 2.5 License", "CC-BY-SA-2.5", ""),
    ("it is free software under the Artistic License 2.0", "Artistic-2.0", ""),
    ("we release it under the WTFPL", "WTFPL", ""),
    ("Use of this source code is governed under a BSD-style license that is in LICENSE", "BSD", ""),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0", ""),
    ("The MIT License\n\n" + licenses.SENTENCES["MITPermission"][0] + ".\n", "MIT", ""),
]


def test_op4_forms_of_files(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(LICENCES)], "doc_id int, text string")
    found = {r["doc_id"]: (r["licences"], r["unexplained"]) for r in licenses.scan(df).collect()}
    assert [found[k] for k in range(len(LICENCES))] == [(a, b) for _, a, b in LICENCES]


def test_op10_prints_grow_with_an_item_and_not_its_square(spark):
    sizes = []
    for n in (2_000, 20_000):
        bench = spark.createDataFrame([(1, [f"w{k % 997}x{k}" for k in range(n)])], "item long, item_words array<string>")
        prints = decontam.item_prints(bench, [])
        sizes.append(prints.agg(F.sum(F.aggregate("item_near", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w)))).first()[0])
    assert sizes[1] < 15 * sizes[0]


@pytest.mark.parametrize("literal_prints", [20_000, 0])
def test_op10_a_long_item_is_found_whole(spark, literal_prints):
    words = [f"v{k * 7919 % 30_011}" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(words[5_000:5_400]) + " after it"), (2, "nothing of it"), (3, " ".join(words[19_985:]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(docs, items, literal_prints=literal_prints).collect()}
    assert found == {1: 400, 2: 0, 3: 15}


def test_op7_ids_with_line_breaks(spark):
    html = "<p>" + "x" * 200 + "</p>"
    ids = ["a\r\nb", "a%0D%0Ab", " : x: ", "%", "é\n", ""]
    pages = spark.createDataFrame([(i, f"http://x/{i}", html) for i in ids] + [("z", None, "short")], "page_id string, url string, html string").repartition(3)
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    first = min(ids)
    assert found == {i: ("response", None) if i == first else ("revisit", first) for i in ids} | {"z": ("response", None)}


def test_op7_payloads_stay_out_of_shuffles(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    plans = []
    plain = warc.staged
    try:
        warc.staged = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), plain(df, name))[1]
        warc.write_archives(pages, f"file://{tmp_path}/out")
    finally:
        warc.staged = plain
    plan = dict(plans)["index"]
    assert "payload" in plan and "Exchange" not in plan and "Join" not in plan
