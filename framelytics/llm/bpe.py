"""Byte-level BPE by a file of ranks: encoding by merge replay over a corpus's words, and decoding.

Every task replays the merges over the distinct pre-tokens of its share of the corpus, all of
them together: an inverted index leads from what a pair of neighbours merges to, to the places
of that pair in all words, and the merges apply in the order of their ranks, touching only
the neighbours of merged places. Texts are then written from the words' ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, members, ranges
from .common import free_name
from .tokens import BYTE_PATTERN, UNUSUAL, cut_plain

#: Pre-tokens that a process remembers; at this many it forgets them. It replays so many at once at most.
REMEMBERED, REPLAYED = 150_000, 100_000
#: Bytes of text that are written at once, and whose words are learnt together; bytes of ids that are decoded at once.
WRITTEN, LEARNT, DECODED = 2_000_000, 12_000_000, 1_000_000
#: A pair of tokens is left << SHIFT | right; END follows a word, GONE is a place that a merge has taken.
SHIFT, END, GONE = 20, -1, -2


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, from lines of base64 and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class Pairs:
    """What two neighbouring tokens merge to: all ways to cut a token of the file into two others."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >= 1 << SHIFT:
            raise ValueError("a rank is too large for a pair's key")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merged = {left << SHIFT | right: rank for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None}
        self.keys = np.array(sorted(merged), np.int64)
        self.values = np.array([merged[k] for k in self.keys.tolist()], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair what it merges to, -1: it doesn't, as with END and GONE."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merged(self, left: int, right: int) -> int:
        """The same for one pair."""
        at = int(np.searchsorted(self.keys, key := left << SHIFT | right))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == key else -1


@cache
def all_pairs(path: str) -> Pairs:
    return Pairs(ranks(path))


class Places(dict):
    """The inverted index: what a pair merges to -> where such pairs begin, in arrays. `queue` has its keys, the least first."""

    def __init__(self) -> None:
        super().__init__()
        self.queue: list[int] = []

    def add(self, merged: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(merged, kind="stable")
        merged, at = merged[order], at[order]
        begins = np.flatnonzero(np.diff(merged, prepend=-1)).tolist()
        for rank, begin, end in zip(merged[begins].tolist(), begins, [*begins[1:], len(at)], strict=True):
            if rank in self:
                self[rank].append(at[begin:end])
            else:
                self[rank] = [at[begin:end]]
                heapq.heappush(self.queue, rank)


def replay(words: list[bytes], pairs: Pairs) -> list[bytes]:
    """The tokens of each word as bytes, all words merged together in the order of the ranks.

    The bytes of all words are places in one row, linked to their neighbours. The inverted
    index leads to the places of each merge, all of which are merged at once; where two
    overlap, the left one. An entry is stale if the pair there has changed since. A merge
    can make pairs only with its two neighbours. A word in which it makes a pair of a lower
    rank than its own is done over by `merged_alone`, as the order within the word decides.
    """
    if not words:
        return []
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in words), np.int64, len(words)))  # after each word a place with END
    tokens = pairs.single[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
    tokens[ends - 1] = END
    after, before = np.minimum(np.arange(len(tokens)) + 1, len(tokens) - 1), np.arange(-1, len(tokens) - 1)
    found = pairs.lookup(tokens[:-1], tokens[1:])
    places, out_of_order = Places(), []
    places.add(found[found >= 0], np.flatnonzero(found >= 0))
    while places.queue:
        rank = heapq.heappop(places.queue)
        at = np.unique(np.concatenate(places.pop(rank)))
        at = at[pairs.lookup(tokens[at], tokens[after[at]]) == rank]
        if not len(at):
            continue
        apart = np.append(True, after[at[:-1]] != at[1:])
        if not apart.all():  # of neighbours that overlap in a row, every other one
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(apart, number, 0))) % 2 == 0]
        gone = after[at]
        tokens[at], tokens[gone] = rank, GONE
        after[at] = beyond = after[gone]
        before[beyond] = at
        at = np.concatenate([before[at], at])
        found = pairs.lookup(tokens[at], tokens[after[at]])
        if (found >= 0).any():
            at, found = at[found >= 0], found[found >= 0]
            out_of_order.append(at[found < rank])
            places.add(found, at)
    after_word = 4 * np.cumsum(tokens >= 0)[ends - 1]
    flat = tokens[tokens >= 0].astype("<u4").tobytes()
    out = [flat[a:b] for a, b in zip([0, *after_word.tolist()], after_word.tolist(), strict=False)]
    for k in np.unique(np.searchsorted(ends, np.concatenate([np.zeros(0, np.int64), *out_of_order]), "right")).tolist():
        out[k] = merged_alone(words[k], pairs)
    return out


def merged_alone(word: bytes, pairs: Pairs) -> bytes:
    """The tokens of one word: of all its pairs the one of the least rank, then the leftmost, merges first."""
    tokens = [*pairs.single[np.frombuffer(word, np.uint8)].tolist(), END]
    after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
    queue = [(rank, k) for k in range(len(word)) if (rank := pairs.merged(tokens[k], tokens[k + 1])) >= 0]
    heapq.heapify(queue)
    while queue:
        rank, place = heapq.heappop(queue)
        if tokens[place] < 0 or pairs.merged(tokens[place], tokens[gone := after[place]]) != rank:
            continue
        tokens[place], tokens[gone] = rank, GONE
        after[place] = beyond = after[gone]
        before[beyond] = place
        for k in (before[place], place):
            if k >= 0 and (other := pairs.merged(tokens[k], tokens[after[k]])) >= 0:
                heapq.heappush(queue, (other, k))
    return np.array([x for x in tokens if x >= 0], "<u4").tobytes()


@cache
def _any_pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


#: Bytes that the cutting of plain bytes can't tell apart: apostrophes may begin a suffix, others lead characters of all classes.
_ODD = members(bytes([0x27, 0xC2, *range(0xCA, 0xE2), *range(0xE3, 0x100)]))


def pre_tokens(chunk: Chunk) -> np.ndarray:
    """Where the pre-tokens of a chunk's texts start."""
    data, begins = chunk.data, chunk.starts[:-1]
    odd = _ODD[data]
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[chunk.starts]) > 0
    sizes = np.diff(chunk.starts)
    plain = np.flatnonzero(~odd & (sizes > 0))
    out = []
    if len(plain):
        firsts = np.cumsum(sizes[plain]) - sizes[plain]
        found = cut_plain(data if len(plain) == len(sizes) else data[ranges(begins[plain], sizes[plain])], firsts, False)
        out.append(found + (begins[plain] - firsts)[np.searchsorted(firsts, found, "right") - 1])
    for k in np.flatnonzero(odd).tolist():
        text = data[begins[k] : begins[k] + sizes[k]].tobytes().decode()
        found = (_any_pattern() if UNUSUAL.search(text) else BYTE_PATTERN).findall(text)
        each = np.fromiter((len(x.encode()) for x in found), np.int64, len(found))
        out.append(begins[k] + np.cumsum(each) - each)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values from their joined bytes and where each starts."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.tobytes())])


class Coder:
    """Pre-token -> ids as bytes, in one process: tokens, and what it has replayed."""

    def __init__(self, path: str) -> None:
        self.pairs = all_pairs(path)
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks(path).items()}
        self.known: dict[bytes, bytes] = {}

    def learn(self, distinct: list[pa.Array]) -> None:
        """Replay the merges for those of these pre-tokens that are neither tokens nor known, all together."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        new = [*{x: None for part in distinct for x in part.to_pylist() if x not in self.whole and x not in self.known}]
        for k in range(0, len(new), REPLAYED):
            self.known.update(zip(new[k : k + REPLAYED], replay(new[k : k + REPLAYED], self.pairs), strict=True))

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The ids of texts as little-endian unsigned 32-bit bytes, in parts."""
        for chunk in chunks(texts, LEARNT):
            parts = [*map(self._coded, chunks(texts.slice(chunk.first, chunk.last - chunk.first), WRITTEN))]
            self.learn([distinct for *_, distinct in parts])
            while parts:
                of_text, codes, distinct = parts.pop(0)
                values = [self.whole.get(x) or self.known[x] for x in distinct.to_pylist()]
                sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
                ids, firsts, n = np.frombuffer(b"".join([*values, b""]), "<u4"), np.cumsum(sizes) - sizes, sizes[codes]
                yield binary(ids[ranges(firsts[codes], n)], 4 * np.concatenate([[0], np.cumsum(n)])[of_text])

    @staticmethod
    def _coded(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The pre-tokens before the start of each text and the end, all pre-tokens as codes, and the distinct ones."""
        starts = pre_tokens(chunk)
        coded = binary(chunk.data, np.append(starts, len(chunk.data)) if len(starts) else np.zeros(1)).dictionary_encode()
        return np.searchsorted(starts, chunk.starts), coded.indices.to_numpy(), coded.dictionary


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id and `ids`, the text's tokens as little-endian unsigned 32-bit bytes.

    path: a file of ranks, at the same place on every machine. No special tokens: their
    strings are ordinary text. A null or empty text has no ids; a null id stays null;
    repeated rows each get their row; an empty table gives an empty result; other columns
    are ignored. A map over the rows, whole texts of any length; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids in coder(path).encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=["id", "ids"])
                at += len(ids)

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes joined, where that of each id starts, and its length; 0: there is none."""
    known = ranks(path)
    tokens = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        tokens[rank] = token
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded(rows: pa.Array, path: str) -> Iterator[pa.Array]:
    """The bytes that the ids of each row stand for, in parts."""
    flat, firsts, sizes = vocabulary(path)
    for chunk in chunks(rows, DECODED):
        ids = np.frombuffer(chunk.data.tobytes(), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(sizes) or not sizes[ids].all()):
            raise ValueError("an id stands for no token")
        yield binary(flat[ranges(firsts[ids], sizes[ids])], np.concatenate([[0], np.cumsum(sizes[ids])])[chunk.starts // 4])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the bytes of its ids; null or empty ids give no bytes.

    An id that the file of ranks lacks is an error. All columns stay; the new one gets
    underscores where its name is taken. A map over the rows.
    """
    name = free_name(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in decoded(batch.column(ids_col).fill_null(b""), path):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(found)).columns, found], names=[*batch.schema.names, name])
                at += len(found)

    schema = type(encoded.schema)([*encoded.schema.fields]).add(name, "binary")
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_tokens, ids_sha256 and decoded_sha256 of `encode` and `decode`."""
    both = decode(encode(docs, path, id_col, text_col), path)
    return both.select(F.col(f"`{id_col}`"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
