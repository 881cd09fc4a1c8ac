"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of tokens; full pieces are sequences of their own. The rest is
dealt to shards of bounded size by a hash of the row. Every shard is evolved on several
islands, each a row with a small population of packings: crossover injects whole
well-filled sequences of one packing into another, drops the sequences that then repeat
a piece and opens some ill-filled ones; displaced pieces change places with smaller ones
where that leaves a sequence fuller, and go back by best fit. Between epochs the best
packing of an island migrates to the next island by a join; the best of all islands is
taken. The loosest sequences of all shards are then opened, and their pieces are dealt
to fewer shards and evolved anew, until one shard is left: what shards waste at their
ends adds up to whole sequences only there. Only numbers are shuffled, never tokens.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encode as encode_texts

CAPACITY, END_ID = 1024, 2
#: generations: children of an island in an epoch, on the first level; there are twice as many on each further level, up to MOST_GENERATIONS, as many as a level of one shard has.
SHARD_ITEMS, ISLANDS, POPULATION, EPOCHS, GENERATIONS, MOST_GENERATIONS = 1500, 2, 5, 2, 20, 160
#: Of a shard's sequences the share that is opened for the next level, and of those the share of full ones with most pieces added to it.
LOOSE, FILLERS = 0.2, 0.125
#: Whole sequences that a crossover injects at most, and ill-filled ones that it opens at most.
INJECTED, OPENED = 6, 40
#: Rows whose texts are sent to Python and encoded at once.
ROWS = 1000
#: Islands that a task is meant for, once there are enough for all cores.
ISLANDS_A_TASK = 8


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter than the others."""
    first = n % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids as little-endian bytes.

    A null text is empty: its document is the end id alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            docs, rows, all_ids = [], [], []
            for at, ids in encode_texts([x or "" for x in batch.column(1).to_pylist()], path):
                found = memoryview(bytes(ids) + end)
                for k, (start, length) in enumerate(cut(len(found) // 4, capacity)):
                    own = found[4 * start : 4 * (start + length)]
                    docs.append(at)
                    rows.append((k, start, length, zlib.crc32(own)))
                    if with_ids:
                        all_ids.append(bytes(own))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))] or [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            columns = [batch.column(0).take(pa.array(docs, pa.int32())), *columns, *([pa.array(all_ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


Packing = list[tuple[int, tuple[int, ...]]]  # each sequence's tokens and items


def best_fit(lengths: list[int], order: list[int], bins: Packing, capacity: int) -> Packing:
    """bins with the items of order added, each to the fullest sequence that has room."""
    fills, items = [f for f, _ in bins], [x for _, x in bins]
    free = sorted((capacity - f, k) for k, f in enumerate(fills) if f < capacity)
    for i in order:
        n = lengths[i]
        at = bisect_left(free, (n, -1))
        if at == len(free):
            fills.append(n)
            items.append((i,))
            insort(free, (capacity - n, len(items) - 1))
        else:
            room, k = free.pop(at)
            fills[k] += n
            items[k] += (i,)
            if room > n:
                insort(free, (room - n, k))
    return list(zip(fills, items))


def best_fit_decreasing(lengths: list[int], capacity: int) -> Packing:
    return best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], capacity)


def fitness(bins: Packing, capacity: int) -> float:
    """Fewer sequences first; among as many, fuller ones."""
    return -len(bins) + sum(f * f for f, _ in bins) / capacity**2 / (len(bins) + 1)


def change_places(lengths: list[int], bins: Packing, open_: list[int], displaced: list[int], capacity: int) -> list[int]:
    """In each of the open sequences a displaced item takes the place of a smaller one where that fills it most; returns who is displaced then."""
    waiting = sorted((lengths[i], i) for i in displaced)
    for k in open_:
        fill, items = bins[k]
        gain, out, at = 0, -1, -1
        for i in items:
            best = bisect_right(waiting, (lengths[i] + capacity - fill, len(lengths))) - 1
            if best >= 0 and waiting[best][0] - lengths[i] > gain:
                gain, out, at = waiting[best][0] - lengths[i], i, best
        if gain:
            _, come = waiting.pop(at)
            insort(waiting, (lengths[out], out))
            bins[k] = (fill + gain, tuple(i for i in items if i != out) + (come,))
    return [i for _, i in waiting]


def crossover(lengths: list[int], to: Packing, other: Packing, capacity: int, random: Random) -> Packing:
    """`to` with whole well-filled sequences of `other`."""
    full = [x for x in other if x[0] == capacity] or sorted(other)[len(other) // 2 :]
    taken = random.sample(full, min(len(full), random.randint(1, INJECTED)))
    inside = {i for _, x in taken for i in x}
    whole, loose, displaced = [], [], []
    for x in to:
        if inside.isdisjoint(x[1]):
            (whole if x[0] == capacity else loose).append(x)
        else:
            displaced += [i for i in x[1] if i not in inside]
    random.shuffle(whole)
    random.shuffle(loose)
    if random.random() < 0.5:  # the emptiest ones, else any
        loose.sort(key=lambda x: x[0])
    n = random.randint(1, max(1, min(OPENED, len(loose) // 2)))
    m = random.randint(0, n // 4)
    displaced += [i for _, x in loose[:n] + whole[:m] for i in x]
    bins = taken + whole[m:]
    bins += sorted(loose[n:], reverse=True)
    open_ = range(len(bins) - len(loose[n:]), len(bins))
    displaced = change_places(lengths, bins, list(open_), displaced, capacity)
    return best_fit(lengths, sorted(displaced, key=lambda i: -lengths[i]), bins, capacity)


def evolve(lengths: list[int], population: list[Packing], capacity: int, generations: int, size: int, random: Random) -> list[Packing]:
    """The best packings after so many generations of one child each, best first. The first of a new population is best fit by falling length."""
    if not population:
        falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        for k in range(size):
            mixed = falling if not k else sorted(falling, key=lambda i: -lengths[i] * random.uniform(0.9, 1))
            population = [*population, best_fit(lengths, mixed, [], capacity)]
    # A number apart keeps equal packings from being compared further.
    ranked = sorted(((fitness(p, capacity), -k, p) for k, p in enumerate(population)), reverse=True)[:size]
    least = -(-sum(lengths) // capacity)
    for k in range(generations):
        if len(ranked[0][2]) <= least:
            break
        a = ranked[0] if random.random() < 0.5 else max(random.sample(ranked, min(2, len(ranked))))
        child = crossover(lengths, a[2], random.choice(ranked)[2], capacity, random)
        score = fitness(child, capacity)
        if all(score != s for s, _, _ in ranked):
            ranked = sorted([*ranked, (score, -len(population) - k, child)], reverse=True)[:size]
    return [p for _, _, p in ranked]


def loosest(bins: Packing, capacity: int) -> set[int]:
    """The sequences to open for the next level: the emptiest that aren't full, and some full ones of many pieces, which fill gaps."""
    order = sorted(range(len(bins)), key=lambda k: (bins[k][0], k))
    out = [k for k in order[: -int(-len(bins) * LOOSE // 1)] if bins[k][0] < capacity]
    full = sorted((k for k in order if bins[k][0] == capacity), key=lambda k: (-len(bins[k][1]), k))
    return {*out, *full[: int(len(out) * FILLERS)]}


def _as_numbers(bins: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, (_, x) in enumerate(bins):
        for i in x:
            out[i] = k
    return out


def _as_bins(numbers: list[int], lengths: list[int]) -> Packing:
    out: list[list[int]] = [[] for _ in range(max(numbers) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return [(sum(lengths[i] for i in x), tuple(x)) for x in out]


STATE = "shard long, island int, items array<long>, lengths array<int>, packings array<array<int>>, fitness double"
ARROW_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("packings", pa.list_(pa.list_(pa.int32()))), ("fitness", pa.float64())])


def _epoch(name: str, capacity: int, generations: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                lengths, migrant = r["lengths"], r.pop("migrant", None)
                own = [_as_bins(p, lengths) for p in (r["packings"] or []) + ([migrant] if migrant else [])]
                found = evolve(lengths, own, capacity, generations, size, Random(f"{name}/{r['shard']}/{r['island']}"))
                r["packings"] = [_as_numbers(b, len(lengths)) for b in found]
                r["fitness"] = fitness(found[0], capacity)
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_STATE)

    return run


def _settle(capacity: int, last: bool):
    """Of the best packings, a row per item: its shard and sequence, which is -1 for items that go to the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                opened = set() if last else loosest(_as_bins(r["bins"], r["lengths"]), capacity)
                numbers = [-1 if k in opened else k for k in r["bins"]]
                columns = [pa.array([r["shard"]] * len(numbers), pa.int64()), pa.array(r["items"], pa.int64()), pa.array(r["lengths"], pa.int32()), pa.array(numbers, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "item", "length", "bin"])

    return run


def _level(items: DataFrame, level: int, shards: int, last: bool, capacity: int, islands: int, population: int, epochs: int, generations: int) -> DataFrame:
    """(shard, item, length, bin) of the best packing of each shard."""
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), F.struct(F.col("length").cast("int").alias("length"), "item").alias("x"))
    # A shard holds about shard_items rows by construction, whatever the data.
    state = dealt.groupBy("shard").agg(F.array_sort(F.collect_list("x")).alias("x"))
    state = state.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("packings"), F.lit(None).cast("array<int>").alias("migrant"))
    n = shards * islands
    # A number of partitions that is asked for isn't coalesced: islands are small in bytes, not in work.
    tasks = min(n, max(2 * items.sparkSession.sparkContext.defaultParallelism, n // ISLANDS_A_TASK))
    for epoch in range(epochs):
        if epoch:
            elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.get("packings", F.lit(0)).alias("migrant"))
            state = state.join(elite, ["shard", "island"], "left").drop("fitness")
        state = state.repartition(tasks, "shard", "island")
        state = staged(state.mapInArrow(_epoch(f"{level}/{epoch}", capacity, generations, population), STATE), "islands")
    best = state.groupBy("shard").agg(F.max_by(F.struct("items", "lengths", F.get("packings", F.lit(0)).alias("bins")), F.struct("fitness", "island")).alias("s")).select("shard", "s.*")
    return staged(best.mapInArrow(_settle(capacity, last), "shard long, item long, length int, bin long"), "packed")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS, levels: bool = True) -> DataFrame:
    """(item, sequence_id, offset) for the rows (item, length) with lengths from 1 to capacity; items are distinct longs.

    The last level is one shard, or one that isn't at most half of the level before. items
    is read more than once. With levels off every shard stays as it is.
    """
    left, level, before, found = items.select("item", "length"), 0, None, None
    while True:
        n = left.count()
        shards = max(1, -(-n // shard_items))
        last = not levels or shards == 1 or (before is not None and 2 * n > before)
        most = max(generations, MOST_GENERATIONS)
        packed = _level(left, level, shards, last, capacity, islands, population, epochs, most if shards == 1 else min(generations << level, most))
        kept = packed.where("bin >= 0").select("item", F.col("length").cast("long").alias("length"), (F.lit(level << 56) + F.col("shard") * 2**20 + F.col("bin")).alias("sequence_id"))
        found = kept if found is None else found.unionByName(kept)
        if last:
            break
        left, level, before = packed.where("bin < 0").select("item", "length"), level + 1, n
    ahead = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("item", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, **settings: int) -> DataFrame:
    """Per piece of every row of docs: the id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most `capacity` tokens; a document of more is cut, its first piece
    being the shorter one. A null or empty text is its end id alone; a null id stays null;
    repeated rows are packed apart; an empty table gives an empty result; other columns
    are ignored. Full pieces have negative sequence ids, shared sequences others.
    """
    pieces = token_pieces(docs, path, id_col, text_col, capacity, end_id)
    pieces = staged(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces", ROWS)
    full = pieces.where(F.col("length") == capacity).select("*", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    placed = rest.join(pack(rest.select("item", "length"), capacity, **settings), "item")
    return full.unionByName(placed).drop("item")
