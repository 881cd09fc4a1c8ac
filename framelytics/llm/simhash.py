"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 22, 21 and 21 bits. Each block is a word of
the 23-bit space that the binary Golay code covers perfectly with radius 3: every word
has one nearest codeword, its home. Fingerprints within 4 bits are within 2 bits on
some pair of blocks, so there are three tables, one per pair, whose anchors are pairs
of codewords. A fingerprint goes once to its home anchor and is replicated to every
anchor within covering radius plus threshold that can be the home of a fingerprint so
close; each home is then compared with the replicas at its anchor only.

Only distinct fingerprints are replicated, so copies cost nothing; each gives about 137
rows of 16 bytes over the three tables. An anchor that would hold many is split into a
grid of cells. Tasks return a spanning forest of the links that they find, not the links,
and components are merged by joins of tables, whose hot keys Spark splits as it runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, new_folder, staged, table_at

SHINGLE, BITS, SEED = 4, 4, 42
BLOCKS = (22, 21, 21)
#: Blocks of each table, and bits that may differ in the first, the second or one in each.
#: A pair within 4 bits that the first table misses differs in at most 1 bit of the third
#: block, and one that the second misses too in at most 1 of the second.
TABLES = ((0, 1, 2, 2), (0, 2, 2, 1), (1, 2, 1, 1))
GOLAY = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: Rows that a cell should hold. Anchors are counted on a share of the fingerprints of which so many rows would fall into a
#: full cell, whatever the size of the input; this decides the cells, never a result.
CELL_ROWS, CROWD_HITS = 50_000, 50
#: Pairs compared at once in a task.
PAIRS = 2_000_000
DIGESTS = 65_536


def fingerprint(text: bytes | None) -> bytes:
    """8 bytes: per bit, 1 if set in over half of the XXH64 of the 4-word shingles of the lower-cased text."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, DIGESTS):
        found = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + DIGESTS)].tolist(), last[k : k + DIGESTS].tolist())])
        counts += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(fingerprint(x) for x in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype("<i8"))], names=["id", "fp"])


@cache
def _syndromes() -> list[np.ndarray]:
    """Of every value of each of the three bytes of a word."""
    one = []
    for k in range(24):
        v = 1 << k
        for s in range(k, 10, -1):
            if v >> s & 1:
                v ^= GOLAY << (s - 11)
        one.append(v)
    tables = []
    for byte in range(3):
        t = np.zeros(256, np.int32)
        for k in range(8):
            t[(np.arange(256) >> k & 1) == 1] ^= one[8 * byte + k]
        tables.append(t)
    return tables


def _syndrome(words: np.ndarray) -> np.ndarray:
    a, b, c = _syndromes()
    return a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]


def _flips(bits: int, most: int) -> np.ndarray:
    one = [1 << k for k in range(bits)]
    out = [0, *one] + ([x | y for k, x in enumerate(one) for y in one[:k]] if most > 1 else [])
    return np.array(out, np.int32)


@cache
def _leaders() -> np.ndarray:
    """The word of weight 3 at most of each syndrome."""
    one = [1 << k for k in range(23)]
    words = [0, *one, *(x | y for k, x in enumerate(one) for y in one[:k]), *(x | y | z for k, x in enumerate(one) for j, y in enumerate(one[:k]) for z in one[:j])]
    out = np.full(2048, -1, np.int32)
    out[_syndrome(np.array(words, np.int32))] = words
    return out


def home(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit number of the nearest codeword of each word, and the word's syndrome."""
    s = _syndrome(words)
    return (words ^ _leaders()[s]) >> 11, s


@cache
def _moves(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome, by what the home's number changes over all flips of up to `most` bits: starts and values.

    Those of up to 1 bit come first in those of up to 2.
    """
    leaders, s = _leaders(), np.arange(2048, dtype=np.int32)[:, None]

    def changes(e: np.ndarray) -> np.ndarray:
        return (leaders[s] ^ e ^ leaders[s ^ _syndrome(e)[None, :]]) >> 11

    rows = [np.unique(r) for r in changes(_flips(bits, 1))]
    if most > 1:
        rows = [np.concatenate([near, np.setdiff1d(r, near)]) for near, r in zip(rows, changes(_flips(bits, 2)))]
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows).astype(np.int64)


def _product(n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each k all pairs of n1[k] x n2[k]: k, first, second."""
    n = n1 * n2
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    return k, at // n2[k], at % n2[k]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: anchor, replica (0 home, 1 replica), and which fingerprint."""
    blocks = ((fps >> np.uint64(42)).astype(np.int32), (fps >> np.uint64(21) & np.uint64(2**21 - 1)).astype(np.int32), (fps & np.uint64(2**21 - 1)).astype(np.int32))
    homes = [home(b) for b in blocks]
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    for table, (i, j, most_i, most_j) in enumerate(TABLES):
        (a, sa), (b, sb) = homes[i], homes[j]
        a, b = a.astype(np.int64), b.astype(np.int64)
        out.append((table << 24 | a << 12 | b, 0, np.arange(len(fps))))
        near = [_moves(BLOCKS[x], 1)[0] for x in (i, j)]
        (fi, vi), (fj, vj) = _moves(BLOCKS[i], most_i), _moves(BLOCKS[j], most_j)
        ni, nj = near[0][sa + 1] - near[0][sa], near[1][sb + 1] - near[1][sb]
        k, p, q = _product(ni, nj)  # at most one bit in each block
        out.append((table << 24 | (a[k] ^ vi[fi[sa[k]] + p]) << 12 | (b[k] ^ vj[fj[sb[k]] + q]), 1, k))
        if most_i > 1:  # two bits in the first, none in the second
            k, p, _ = _product(fi[sa + 1] - fi[sa] - ni, np.ones_like(ni))
            out.append((table << 24 | (a[k] ^ vi[fi[sa[k]] + ni[k] + p]) << 12 | b[k], 1, k))
        if most_j > 1:
            k, _, q = _product(np.ones_like(nj), fj[sb + 1] - fj[sb] - nj)
            out.append((table << 24 | a[k] << 12 | (b[k] ^ vj[fj[sb[k]] + nj[k] + q]), 1, k))
    return np.concatenate([x for x, _, _ in out]), np.concatenate([np.full(len(x), r, np.int64) for x, r, _ in out]), np.concatenate([k for _, _, k in out])


def _replicate(crowded: np.ndarray, sides: np.ndarray):
    """crowded: sorted anchors; sides: their grids are sides x sides cells. The key is cell, anchor, replica."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2000):
                fps = every[at : at + 2000]
                anchor, replica, k = anchors(fps)
                cell = np.zeros(len(anchor), np.int64)
                if len(crowded):
                    g = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                    side = np.where(crowded[g] == anchor, sides[g], 1)
                    mixed = (fps[k] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    take = np.repeat(np.arange(len(anchor)), side)
                    other = np.arange(len(take)) - np.repeat(np.cumsum(side) - side, side)
                    anchor, replica, k, mine, n = anchor[take], replica[take], k[take], mixed[take] % side[take], side[take]
                    cell = np.where(replica == 0, mine * n + other, other * n + mine)
                key = (cell << 27 | anchor) << 1 | replica
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[k].view(np.int64))], names=["key", "fp"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component among these links), nodes other than the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(bits: int):
    """Over rows sorted by key. Homes of an anchor come before its replicas, so homes alone are carried on."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = key >> 1
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(key)))
        homes = np.add.reduceat((key & 1) == 0, first) if len(first) else size
        pairs, start = homes * (size - homes), 0
        ends, out = np.cumsum(pairs), []
        total = int(ends[-1]) if len(ends) else 0
        while start < total:
            stop = min(total, start + PAIRS)
            lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1
            part = np.minimum(ends[lo:hi], stop) - np.maximum(ends[lo:hi] - pairs[lo:hi], start)
            g = np.repeat(np.arange(lo, hi), part)
            q = np.arange(start, stop) - (ends - pairs)[g]
            others = (size - homes)[g]
            x, y = fp[first[g] + q // others], fp[first[g] + homes[g] + q % others]
            near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
            if near.any():
                out.append(forest(x[near], y[near]))
            start = stop
        if not out:
            return fp[:0], fp[:0]
        return forest(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (np.empty(0, np.int64), np.empty(0, np.uint64))
        waiting, n = [], 0

        def flush():
            nonlocal carried, waiting, n
            key = np.concatenate([carried[0], *(x for x, _ in waiting)])
            fp = np.concatenate([carried[1], *(x for _, x in waiting)])
            waiting, n = [], 0
            a, b = links(key, fp)
            open_ = (key >> 1 == key[-1] >> 1) & (key & 1 == 0)
            carried = key[open_], fp[open_]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if len(batch):
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
                n += len(batch)
                if n >= 200_000:
                    yield flush()
        if n:
            yield flush()

    return run


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that join every two values of the column fp within `bits` (at most 4), as a spanning set.

    fps: distinct, non-null longs, from a table, as it is read more than once.
    """
    if bits > BITS:
        raise ValueError("the tables cover up to 4 bits")
    share = min(1.0, CROWD_HITS / CELL_ROWS)
    none = np.empty(0, np.int64)
    some = fps.sample(share, seed=1).mapInArrow(_replicate(none, none), "key long, fp long")
    # A crowded anchor has over CELL_ROWS rows and each fingerprint about 137, so there is at most one for each CELL_ROWS / 137.
    found = some.groupBy(F.shiftright("key", 1).alias("anchor")).count().where(F.col("count") * F.lit(1 / share) > CELL_ROWS).collect()
    found = sorted((r["anchor"], math.ceil(r["count"] / share / CELL_ROWS)) for r in found)
    crowded, sides = np.array([a for a, _ in found], np.int64), np.array([s for _, s in found], np.int64)
    rows = fps.mapInArrow(_replicate(crowded, sides), "key long, fp long")
    rows = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return rows.mapInArrow(_compare(bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, least): of every node of the links (a, b) the least node reachable, by large- and small-star joins.

    Each round is a table in the shared folder; it ends when a round changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    spark, before = edges.sparkSession, None
    paths = [new_folder(spark, "links")]
    edges = table_at(edges, paths[0])

    def table(df: DataFrame) -> DataFrame:
        paths.append(new_folder(spark, "links"))
        return table_at(df, paths[-1])

    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = now
        # Both sides of a join are read from tables: an aggregation next to it would keep a hot key in one task.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").distinct())
        least = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = table(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        while len(paths) > 1:
            discard(paths.pop(0))


def _rooted(prints: DataFrame, key: str, bits: int) -> DataFrame:
    """(fp, root, key), a table: of each distinct fp of prints its component's root and its least key."""
    nodes = staged(prints.groupBy("fp").agg(F.min(key).alias(key)), "distinct")
    merged = components(links(nodes.select("fp"), bits))
    return staged(nodes.join(merged, nodes["fp"] == merged["node"], "left").select("fp", F.coalesce("least", "fp").alias("root"), key), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row of docs: the id, fingerprint (16 hex digits) and component_id.

    component_id is the least id that links of at most `bits` differing bits reach. A null
    or empty text has the fingerprint zero and links like any other. A null id is no
    candidate for component_id, which is null only where a component has no id at all.
    Repeated rows each get their row; an empty table gives an empty result; other columns
    are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    prints = staged(slim.mapInArrow(_fingerprints, f"id {kind}, fp long"), "fingerprints")
    rooted = _rooted(prints, "id", bits)
    lows = staged(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "lows")
    named = staged(rooted.join(lows, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of docs, with all its columns, of each component: the one with the least id, nulls last.

    Rows are told apart by a key that is written with them, so rows that share an id, or
    have none, each stand or fall by their own text; among equal ids the least key stays.
    """
    key = free_name(docs, "row")
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    own = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(key).alias("row"))
    slim = keyed.select(own.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("fp", T.LongType())])
    prints = staged(slim.mapInArrow(_fingerprints, schema), "fingerprints")
    first = _rooted(prints, "id", bits).groupBy("root").agg(F.min("id").alias("id")).select(F.col("id.row").alias(key))
    later = staged(prints.select(F.col("id.row").alias(key)).join(staged(first, "first"), key, "left_anti"), "later")
    return keyed.join(later, key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
