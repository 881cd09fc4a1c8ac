"""An n-gram language model as an Elias-Fano trie of three levels, built and queried by Spark.

Level 1 holds the words: their sorted 64-bit hashes as an Elias-Fano sequence, and their
counts. A word's number is its place there. Level n holds the n-grams: for each context,
an entry of the level above, the sorted numbers of its successors, made one monotone
sequence by adding the context's base, Elias-Fano coded, with monotone pointers to where
each context starts, a quantised probability for each n-gram and a quantised weight for
each context. An n-gram's number is its place in its level. It is found by a successor
search from its context's base. Levels are cut into slices of about as many n-grams,
wherever these bounds fall, also within a context; slices are files in the shared folder.

Probabilities are discounted, and interpolated with those of the level above:
    p(w|uv) = max(c(uvw) - D, 0) / c(uv) + D * N(uv) / c(uv) * p(w|v),  N: different successors
    p(w|v) likewise by p(w) = (c(w) + a) / (n + a (V + 1))
Contexts that were never seen leave the level above as it is.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, new_folder

ADDED, DISCOUNT, ORDER, CODE_BITS = 0.1, 0.75, 3, 8
#: Bytes of text that a slice of level 1 is meant for, tokens for a slice of the others, and n-grams sampled to place their bounds.
WORD_SLICE_BYTES, SLICE_TOKENS, BOUND_SAMPLE = 16_000_000, 1_000_000, 200_000
#: Bytes of slices that a task keeps where the shared folder can't be mapped into memory.
KEPT_BYTES = 256_000_000
#: Bytes of text worked on at once, and keys that a task gathers before it sends them.
TEXT_BYTES, GATHERED = 12_000_000, 6_000_000


def _put(values: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned values of so many bits (at most 63), packed into 64-bit words, and one word more."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift > np.uint64(64 - bits)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _get(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low, high = words[word] >> shift, np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th set bit of each byte, at k * 256 + byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th (from 0) set bit, or with flip clear bit. before: such bits before each word."""
    at = np.searchsorted(before, k, "right") - 1
    left, w = (k - before[at]).astype(np.uint64), words[at]
    w = ~w if flip else w
    # Each byte of sums has the set bits up to its end; bytes whose sum isn't over the rank are passed over.
    sums = w - ((w >> np.uint64(1)) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    shift = np.bitwise_count((left * _BYTES | _TOPS) - sums & _TOPS).astype(np.uint64) << np.uint64(3)
    left -= ((sums << np.uint64(8)) >> shift) & np.uint64(255)
    byte = (w >> shift) & np.uint64(255)
    return at * 64 + shift.astype(np.int64) + _IN_BYTE[((left << np.uint64(8)) | byte).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers in 2 + log2(range / length) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((int(upper[-1]) if n else 0) // 64 * 64 + (n + 128) // 64 * 64 + 64, np.uint8)
        flags[upper + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.cumsum(64 - ones) - (64 - ones)
        return cls(n, bits, _put(values & np.uint64((1 << bits) - 1), bits), high, zeros)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have an upper part under h."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        last = int(self.zeros[-1]) + int(64 - np.bitwise_count(self.high[-1]))
        k = np.minimum(h[some] - 1, last - 1)
        out[some] = np.minimum(_select(self.high, self.zeros, k, True) - k, self.n)
        return out

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not under each value (the successor), and whether it is the value."""
        upper = (values >> np.uint64(self.bits)).astype(np.int64)
        lower = values & np.uint64((1 << self.bits) - 1)
        lo, end = self._below(upper), self._below(upper + 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = _get(self.low, self.bits, mid) < lower[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = _get(self.low, self.bits, lo[found]) == lower[found]
        return lo, found

    def at(self, index: np.ndarray) -> np.ndarray:
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        upper = _select(self.high, ones, index, False) - index
        return (upper.astype(np.uint64) << np.uint64(self.bits)) | _get(self.low, self.bits, index)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*map(int, a[f"{name}.size"]), a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.zeros"])


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays as one file under a name of its own; returns its URI."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    uri = posixpath.join(folder, f"{uuid.uuid4().hex}.slice")
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_output_stream(path) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    return uri


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.memmap(path, np.uint8, "r")


_kept: dict[str, np.ndarray] = {}


def _fetched(uri: str, files: pafs.FileSystem, path: str) -> np.ndarray:
    """A slice read whole; what was used longest ago goes beyond KEPT_BYTES. Keys are looked up slice by slice."""
    data = _kept.pop(uri, None)
    if data is None:
        with files.open_input_file(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
        while _kept and sum(map(len, _kept.values())) + len(data) > KEPT_BYTES:
            _kept.pop(next(iter(_kept)))
    _kept[uri] = data
    return data


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory if the shared folder is mounted, else read."""
    files, path = pafs.FileSystem.from_uri(uri)
    data = _mapped(path) if isinstance(files, pafs.LocalFileSystem) else _fetched(uri, files, path)
    n = int.from_bytes(bytes(data[:8]), "little")
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: data[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in head.items()}


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def split(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of all texts as codes, the distinct words, and the number of words of each text."""
    joined = b" ".join(texts).lower()
    space = np.concatenate([[True], _SPACES[np.frombuffer(joined, np.uint8)]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))]))
    if not len(starts):
        return np.empty(0, np.int64), [], counts
    body = joined.strip(b" \t\n\r\x0b\x0c")
    one = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(body)], np.int32)), pa.py_buffer(body)])
    words = pc.ascii_split_whitespace(one).flatten().cast(pa.binary()).dictionary_encode()
    _, offsets, data = words.dictionary.buffers()
    bounds, raw = np.frombuffer(offsets, np.int32)[: len(words.dictionary) + 1].tolist(), data.to_pybytes()
    return words.indices.to_numpy().astype(np.int64), [raw[a:b] for a, b in zip(bounds, bounds[1:])], counts


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def parts(batch_texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, size, out = 0, 0, []
    for k, x in enumerate(batch_texts):
        out.append(x or b"")
        size += len(out[-1])
        if size >= TEXT_BYTES:
            yield start, out
            start, size, out = k + 1, 0, []
    if out:
        yield start, out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their steps, then the counts', compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = lambda a: a.view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes(steps) + planes(counts.astype(np.uint64)))


def _unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(16, -1)
    whole = lambda a: np.ascontiguousarray(a.T).view(np.uint64).ravel()
    return np.cumsum(whole(raw[:8]), dtype=np.uint64), whole(raw[8:]).astype(np.int64)


def _gather(keys_of, slice_of):
    """A map that adds up sorted keys and their counts: rows (slice, keys), a task's keys being merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send():
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            where = slice_of(keys)
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(keys) else np.zeros(1, int)
            data = [_squeeze(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]], pa.int64()), pa.array(data, pa.binary())], names=["slice", "keys"])

        for batch in batches:
            for _, texts in parts(batch.column(0).to_pylist()):
                found = keys_of(texts)
                held.append(found)
                n += len(found[0])
                if n >= GATHERED:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    return run


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = [_unsqueeze(x) for x in rows.column("keys").to_pylist()]
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


@dataclass(frozen=True)
class Words:
    """Level 1. slices: (first number, file) of each slice of hashes, None if empty; docs: texts, tokens: words and ends."""

    slices: tuple[tuple[int, str | None], ...]
    size: int
    docs: int
    tokens: int

    @property
    def width(self) -> int:
        """Numbers of tokens are under it; the last one stands for the end, and as a context for the start, of a text."""
        return self.size + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        keys = hashes(words)
        order = np.argsort(keys)
        keys, out = keys[order], np.full(len(words), -1, np.int64)
        edge = np.searchsorted(_word_slice(keys, len(self.slices)), np.arange(len(self.slices) + 1))
        for k, (first, uri) in enumerate(self.slices):
            a, b = edge[k], edge[k + 1]
            if a < b and uri:
                place, found = EliasFano.from_arrays(load(uri), "hash").find(keys[a:b])
                out[order[a:b][found]] = first + place[found]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted numbers."""
        out = np.zeros(len(numbers), np.int64)
        out[numbers == self.size] = self.docs
        firsts = [f for f, _ in self.slices] + [self.size]
        edge = np.searchsorted(numbers, firsts)
        for k, (first, uri) in enumerate(self.slices):
            if edge[k] < edge[k + 1]:
                out[edge[k] : edge[k + 1]] = load(uri)["count"][numbers[edge[k] : edge[k + 1]] - first]
        return out


def _word_slice(keys: np.ndarray, slices: int) -> np.ndarray:
    """slices: a power of two."""
    return (keys >> np.uint64(64 - (slices - 1).bit_length())).astype(np.int64)


def build_words(texts: DataFrame) -> Words:
    """texts: one binary column. Null texts count as empty."""
    folder = _folder(texts, "lm-words")
    size = texts.agg(F.count("*").alias("docs"), F.sum(F.octet_length(F.col(texts.columns[0]))).alias("bytes")).first()
    slices = 1 << max(4, (int(size["bytes"] or 0) // WORD_SLICE_BYTES).bit_length())

    def keys_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes, words, _ = split(part)
        return summed(hashes(words), np.bincount(codes, minlength=len(words)).astype(np.int64))

    def level(rows: pa.Table) -> pa.Table:
        keys, counts = _merged(rows)
        uri = save(folder, EliasFano.of(keys).arrays("hash") | {"count": counts})
        return pa.table({"slice": [rows.column("slice")[0].as_py()], "uri": [uri], "n": [len(keys)], "total": [int(counts.sum())]})

    rows = texts.mapInArrow(_gather(keys_of, lambda keys: _word_slice(keys, slices)), "slice long, keys binary")
    found = {r["slice"]: r for r in rows.groupBy("slice").applyInArrow(level, "slice long, uri string, n long, total long").collect()}
    out, at = [], 0
    for k in range(slices):
        out.append((at, found[k]["uri"] if k in found else None))
        at += found[k]["n"] if k in found else 0
    return Words(tuple(out), at, size["docs"], size["docs"] + sum(r["total"] for r in found.values()))


@dataclass(frozen=True)
class Level:
    """A level from 2 on. slices: (first key, first number, file, file of counts), in order; a key is context * width + token."""

    width: int
    size: int
    slices: tuple[tuple[int, int, str, str | None], ...]

    @cached_property
    def _firsts(self) -> np.ndarray:
        return np.array([x[0] for x in self.slices], np.uint64)

    def spans(self, sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(slice, start, end) of the keys that fall into each slice; keys before the first slice are left out."""
        edge = np.append(np.searchsorted(sorted_keys, self._firsts), len(sorted_keys))
        for k in np.flatnonzero(edge[1:] > edge[:-1]):
            yield int(k), int(edge[k]), int(edge[k + 1])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys their numbers, -1 if unseen, and quantised discounted probabilities, 0 if unseen."""
        number, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for k, lo, hi in self.spans(keys):
            a = load(self.slices[k][2])
            place, found = EliasFano.from_arrays(a, "key").find(keys[lo:hi] - a["base"][0])
            at = np.flatnonzero(found) + lo
            number[at] = self.slices[k][1] + place[found]
            p[at] = a["book"][a["code"][place[found]]]
        return number, p

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """Of sorted contexts the weight of the level above: D * N / c, a sum over the slices that a context is in; 0 if unseen."""
        out = np.zeros(len(contexts))
        if not self.slices or not len(contexts):
            return out
        low = contexts.astype(np.uint64) * np.uint64(self.width)
        first = np.maximum(np.searchsorted(self._firsts, low, "right") - 1, 0)
        last = np.maximum(np.searchsorted(self._firsts, low + np.uint64(self.width - 1), "right") - 1, 0)
        touched = np.zeros(len(self.slices) + 1, np.int64)
        np.add.at(touched, first, 1)
        np.add.at(touched, last + 1, -1)
        for k in np.flatnonzero(np.cumsum(touched)[:-1]):
            a = load(self.slices[k][2])
            lo, hi = np.searchsorted(contexts, [a["contexts"][0], a["contexts"][1] + 1])
            if lo < hi:
                pointers, at = EliasFano.from_arrays(a, "pointer"), contexts[lo:hi] - a["contexts"][0]
                some = np.flatnonzero(pointers.at(at + 1) > pointers.at(at))
                out[lo + some] += a["weight_book"][a["weight"][at[some]]]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted numbers; only the build of the next level reads them."""
        out = np.zeros(len(numbers), np.int64)
        edge = np.searchsorted(numbers, [x[1] for x in self.slices] + [self.size])
        for k in np.flatnonzero(edge[1:] > edge[:-1]):
            out[edge[k] : edge[k + 1]] = load(self.slices[k][3])["count"][numbers[edge[k] : edge[k + 1]] - self.slices[k][1]]
        return out


@dataclass(frozen=True)
class Model:
    words: Words
    levels: tuple[Level, ...]

    @property
    def contexts(self) -> Words | Level:
        """The level whose entries are the contexts of the next one."""
        return self.levels[-1] if self.levels else self.words


def tokens_of(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the texts, ends included: its number (-1: unknown), whether it's a text's first; tokens per text; the sorted different tokens, and the place of every token among them."""
    codes, distinct, counts = split(texts)
    own, rank = np.unique(np.append(words.numbers(distinct), words.size), return_inverse=True)
    n = counts + 1
    ends = np.cumsum(n) - 1
    at, first = np.full(int(n.sum()), rank[-1], np.int64), np.zeros(int(n.sum()), bool)
    inner = np.ones(len(at), bool)
    inner[ends] = False
    at[inner] = rank[codes]
    first[ends + 1 - n] = True
    return own[at], first, n, own, at


def walk(model: Model, token: np.ndarray, first: np.ndarray, own: np.ndarray, at: np.ndarray) -> Iterator[tuple[Level | None, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Per level: it, sorted contexts, the place of every token's context among them (-1: none or unseen), and quantised discounted probabilities.

    own, at: the sorted different tokens, and the place of every token among them. At last
    come the contexts of the next level alone. Numbers rise with keys, so the found keys of
    a level are the sorted contexts of the next one.
    """
    follows = np.flatnonzero(~first)
    unknown = int(len(own) > 0 and own[0] < 0)
    contexts, places = own[unknown:], np.full(len(token), len(own) - 1 - unknown)  # the start of a text has the last number
    places[follows] = at[follows - 1] - unknown
    for level in model.levels:
        some = np.flatnonzero((places >= 0) & (token >= 0))
        keys, which = np.unique(contexts[places[some]].astype(np.uint64) * np.uint64(level.width) + token[some].astype(np.uint64), return_inverse=True)
        number, p = level.look_up(keys)
        found = np.zeros(len(token))
        found[some] = p[which]
        yield level, contexts, places, found
        seen = number >= 0
        longer = np.full(len(token), -1, np.int64)
        longer[some] = np.where(seen, np.cumsum(seen) - 1, -1)[which]
        contexts, places = number[seen], np.full(len(token), -1, np.int64)
        places[follows] = longer[follows - 1]
    yield None, contexts, places, None


def build_level(texts: DataFrame, model: Model, discount: float = DISCOUNT, bits: int = CODE_BITS, with_counts: bool = True) -> Level:
    """The n-grams one longer than the model's; with their counts if there is to be a next level."""
    folder, width, above = _folder(texts, "lm-ngrams"), model.words.width, model.contexts
    if (above.size + 1) * width >= 1 << 64:
        raise ValueError("the contexts and words are too many for keys of 64 bits")
    slices = max(16, model.words.tokens // SLICE_TOKENS)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def keys_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        token, first, _, own, at = tokens_of(shared.value.words, part)
        *_, (_, contexts, places, _) = walk(shared.value, token, first, own, at)
        return counted(contexts[places[places >= 0]].astype(np.uint64) * np.uint64(width) + token[places >= 0].astype(np.uint64))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in parts(batch.column(0).to_pylist()):
                keys, _ = keys_of(part)
                keys = keys[hashed(keys) % np.uint64(1000) < np.uint64(1000 * of_keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    # Texts of ten times as many tokens are drawn, and of their n-grams a part by a hash.
    of_texts = min(1.0, 10 * BOUND_SAMPLE / model.words.tokens)
    of_keys = min(1.0, BOUND_SAMPLE / max(1.0, of_texts * model.words.tokens))
    found = texts.sample(of_texts, seed=1).mapInArrow(drawn, "key long").toArrow().column("key").to_numpy().astype(np.uint64)
    found.sort()
    bounds = np.unique(found[np.linspace(0, len(found), slices, endpoint=False).astype(np.int64)[1:]]) if len(found) else found

    def level(rows: pa.Table) -> pa.Table:
        keys, counts = _merged(rows)
        context = (keys // np.uint64(width)).astype(np.int64)
        first, last = int(context[0]), int(context[-1])
        starts = np.searchsorted(context, np.arange(first, last + 2)).astype(np.uint64)
        own, at, n = np.unique(context, return_inverse=True, return_counts=True)
        total = shared.value.contexts.counts(own)
        code, book = quantised(np.log10(np.maximum(counts - discount, 1e-9) / total[at]), bits)
        own_code, weight_book = quantised(np.log10(discount * n / total), bits)
        weight = np.zeros(last - first + 1, own_code.dtype)
        weight[own - first] = own_code
        base = np.uint64(first) * np.uint64(width)
        arrays = EliasFano.of(keys - base).arrays("key") | EliasFano.of(starts).arrays("pointer")
        uri = save(folder, arrays | {"code": code, "book": 10.0**book, "weight": weight, "weight_book": 10.0**weight_book, "contexts": np.array([first, last], np.int64), "base": np.array([base], np.uint64)})
        return pa.table({"uri": [uri], "counts": pa.array([save(folder, {"count": counts}) if with_counts else None], pa.string()), "first": [str(int(keys[0]))], "n": [len(keys)]})

    rows = texts.mapInArrow(_gather(keys_of, lambda keys: np.searchsorted(bounds, keys, "right")), "slice long, keys binary")
    rows = rows.repartition(slices, "slice")  # a task merges a slice or a few, however many there are
    found = sorted(rows.groupBy("slice").applyInArrow(level, "uri string, counts string, first string, n long").collect(), key=lambda r: int(r["first"]))
    ahead = np.cumsum([0, *(r["n"] for r in found)])
    return Level(width, int(ahead[-1]), tuple((int(r["first"]), int(at), r["uri"], r["counts"]) for r, at in zip(found, ahead)))


def hashed(keys: np.ndarray) -> np.ndarray:
    """Mixed bits, for draws by key."""
    return (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def build(texts: DataFrame, order: int = ORDER, discount: float = DISCOUNT, bits: int = CODE_BITS) -> Model:
    """The trie of n-grams up to the order, over texts of one binary column."""
    model = Model(build_words(texts), ())
    for n in range(2, order + 1 if model.words.docs else 0):
        model = Model(model.words, (*model.levels, build_level(texts, model, discount, bits, n < order)))
    return model


def quantised(logs: np.ndarray, bits: int = CODE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: equal bins between least and greatest, each read back as the mean of its members."""
    lo, hi = float(logs.min()), float(logs.max())
    n = 1 << bits
    code = np.minimum((logs - lo) / (hi - lo or 1) * n, n - 1).astype(np.uint8 if bits <= 8 else np.uint16)
    size = np.bincount(code, minlength=n)
    return code, np.bincount(code, logs, minlength=n) / np.maximum(size, 1)


def _folder(df: DataFrame, name: str) -> str:
    folder = new_folder(df.sparkSession, name)
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return folder


def log10_probabilities(model: Model, texts: list[bytes], added: float = ADDED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, known tokens, log10 of the product of word probabilities, and of the model's."""
    words = model.words
    token, first, n, own, at = tokens_of(words, texts)
    count = words.counts(own)[at]
    p1 = (count + added) / (words.tokens + added * (words.size + 1 + (words.docs > 0)))
    p = p1.copy()
    for level, contexts, places, found in walk(model, token, first, own, at):
        if level:
            weight = np.append(level.weights(contexts), 0.0)[places]  # place -1 is the 0 at the end
            p = np.where(weight > 0, weight * p + found, p)
    start = np.cumsum(n) - n
    add = lambda x: np.add.reduceat(x, start) if len(start) else x
    return n, add((count > 0).astype(np.int64)), add(np.log10(p1)), add(np.log10(p))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, discount: float = DISCOUNT, order: int = ORDER, bits: int = CODE_BITS) -> DataFrame:
    """Per row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows whose crc32(id as text) mod folds is not held. A null text is empty: its
    end alone. A null id is neither learned from nor held out; repeated rows each get their
    row (and are each learned from); with nothing to learn from all words are unknown. Other
    columns are ignored. The model is built now, the scores are computed lazily.
    """
    at = fold(F.col(f"`{id_col}`"), folds)
    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    texts = docs.where((at >= 0) & (at != held)).select(text)
    built = build(texts, order, discount, bits)
    words, model = built.words, docs.sparkSession.sparkContext.broadcast(built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in parts(batch.column(2).to_pylist()):
                found = log10_probabilities(model.value, part)
                kept = [c.slice(start, len(part)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), (at == held).alias("held_out"), text)
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
