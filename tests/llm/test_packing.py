"""The genetic algorithm against best fit, and packings in levels."""

from random import Random

import pytest

from framelytics.llm import packing, queries


def triplets(n, capacity=1024, seed=1):
    """Items of which three at a time fill a sequence exactly, so n sequences are the least."""
    random, out = Random(seed), []
    for _ in range(n):
        a = random.randint(380, 490)
        b = random.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return out


def test_evolution_beats_best_fit():
    lengths = triplets(40)
    plain = packing.best_fit_decreasing(lengths, 1024)
    found = packing.evolve(lengths, [], 1024, 400, 6, Random(3))[0]
    assert sorted(i for _, x in found for i in x) == list(range(len(lengths)))
    assert all(f == sum(lengths[i] for i in x) <= 1024 for f, x in found)
    assert len(plain) >= 45 and len(found) <= 42


def test_crossover_keeps_every_item():
    random = Random(0)
    lengths = [random.randint(1, 1000) for _ in range(300)]
    a, b = (packing.best_fit(lengths, random.sample(range(300), 300), [], 1024) for _ in range(2))
    for _ in range(50):
        child = packing.crossover(lengths, a, b, 1024, random)
        assert sorted(i for _, x in child for i in x) == list(range(300)) and all(f == sum(lengths[i] for i in x) <= 1024 for f, x in child)
        a, b = b, child


@pytest.fixture(scope="module")
def short(spark):
    """The pieces of sf0.1 that don't fill a sequence."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pieces = packing.token_pieces(docs, queries.tokenizer("byte_bpe_50k.json")).where("length < 1024")
    rows = [(k, r["length"]) for k, r in enumerate(sorted(pieces.select("doc_id", "length").collect()))]
    return spark.createDataFrame(rows, "item long, length long"), [n for _, n in rows]


def test_levels_save_what_shards_waste(spark, short):
    items, lengths = short
    count = lambda df: df.select("sequence_id").distinct().count()
    apart, together = count(packing.pack(items, generations=0, levels=False)), packing.pack(items).collect()
    fill = {}
    for r in together:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["item"]]))
    assert sorted(r["item"] for r in together) == list(range(len(lengths)))
    for rows in fill.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(fill) < apart and len(fill) <= -(-sum(lengths) // 1024) + 2


@pytest.mark.parametrize("rows", [[], [(5, 1024)], [(1, 1), (2, 1)]])
def test_few_items(spark, rows):
    found = packing.pack(spark.createDataFrame(rows, "item long, length long")).collect()
    assert sorted(r["item"] for r in found) == [i for i, _ in rows] and len({r["sequence_id"] for r in found}) == min(1, len(rows))
