"""Token counts with a whole-token shortcut, and token ids, by the tokenizers library.

Both cut texts into pre-tokens and look each distinct one up; only one not seen before is
merged by the library's model. Plain texts are cut together as arrays of bytes, others of
Latin letters, digits and common punctuation by a pattern in which Unicode's classes are
spelled out. Texts of all other scripts are cut at special strings, which are a token each,
and the parts between by the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens that a task remembers; at this many it forgets all but the proven ones.
REMEMBERED = 400_000
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ʯⱥⱦ"
DIGITS = "0-9²³¹¼½¾"
SPACES = "\\t-\\r \\x85\\xa0"
#: Of these characters the classes above hold all letters, digits and spaces, also in lower case, and NFC changes none.
UNUSUAL = re.compile("[^\\x00-ɏ‐-‧‰-⁞₠-₿]")
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: The patterns of the two tokenizer files.
WORD_PATTERN = re.compile(f"{SUFFIXES}|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
BYTE_PATTERN = re.compile(f"{SUFFIXES}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def spelled(pre_token: bytes) -> str:
    """Letters and digits stand for themselves, most of them after one space."""
    if pre_token.isalnum():
        return pre_token.decode("ascii")
    if pre_token[0] == 32 and pre_token[1:].isalnum():
        return "Ġ" + pre_token[1:].decode("ascii")
    return pre_token.decode("latin-1").translate(byte_letters())


class Merger:
    """One tokenizer file in one process: its pre-tokens of any text, and what the library's model gives for one."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {t.content: number for number, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or "(?!)")
        self.back = {ord(c): b for b, c in byte_letters().items()}

    def ids(self, pre_token: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(spelled(pre_token))]

    def usual(self, text: str) -> bool:
        return not any(x in text for x in self.special) and (text.isascii() or not UNUSUAL.search(text))

    def cut(self, text: str) -> Iterator[tuple[int, list[bytes]]]:
        """For each special string its id, and for the text before it, and at the end, -1 and the pre-tokens as bytes."""
        normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else lambda x: x
        at = 0
        for found in [*self.at_special.finditer(text), None]:
            part = text[at : found.start() if found else len(text)]
            if part:
                yield -1, [x.translate(self.back).encode("latin-1") for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normalise(part))]
            if found:
                yield self.special[found.group()], []
                at = found.end()


def proven_whole(path: str, suffix: str = "</w>") -> frozenset[str]:
    """The vocabulary strings of any script that alone are one pre-token, unchanged, and that the model gives back as that one token.

    At most the size of the vocabulary.
    """
    merger = Merger(path)
    back = {c: b for b, c in byte_letters().items()}
    out = set()
    for entry, number in merger.tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(suffix) or entry == suffix or any(c not in back for c in entry.removesuffix(suffix)):
            continue
        try:
            text = bytes(back[c] for c in entry.removesuffix(suffix)).decode()
        except UnicodeDecodeError:
            continue
        if [*merger.cut(text)] == [(-1, [text.encode()])] and merger.ids(text.encode()) == [number]:
            out.add(text)
    return frozenset(out)


#: Classes of the bytes of plain text: space, other white space, letter, digit, other, and inside a character.
SPACE, WHITE, LETTER, DIGIT, OTHER, INSIDE = range(6)


@cache
def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13]] = WHITE
    out[32] = SPACE
    out[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER  # C3-C9 lead U+00C0 to U+024F
    out[48:58] = DIGIT
    out[0x80:0xC0] = INSIDE
    return out


#: Apostrophes, which may begin a suffix, and characters that the byte classes don't tell; what these occur in is cut by the pattern.
_ODD_BYTES = b"'\xC2" + bytes([*range(0xCA, 0xE2), *range(0xE3, 0x100)])
_EVEN_BYTES = bytes(b for b in range(256) if b not in _ODD_BYTES)


def cut_plain(data: np.ndarray, docs: np.ndarray, words: bool) -> np.ndarray:
    """Where the pre-tokens of plain texts start, white space included.

    data: the texts' bytes; docs: where each non-empty text starts. With words every digit
    is apart and white space joins nothing; else the space before a run belongs to it.
    """
    kind = _classes()[data]
    for _ in range(2):  # a character has up to three bytes
        inside = np.flatnonzero(kind == INSIDE)
        inside = inside[kind[inside - 1] != INSIDE]
        kind[inside] = kind[inside - 1]
    white = kind <= WHITE
    group = np.where(white, SPACE, kind)
    first = np.zeros(len(data) + 1, bool)
    first[docs] = True
    first[len(data)] = True
    starts = first[:-1].copy()
    starts[1:] |= group[1:] != group[:-1]
    if words:
        starts |= kind == DIGIT
        return np.flatnonzero(starts)
    joined = np.zeros(len(data), bool)  # runs whose text continues a space before them
    joined[1:] = starts[1:] & ~white[1:] & ~first[1:-1] & (kind[:-1] == SPACE)
    last = white & ~first[1:]  # white space before other text of the same document
    last[:-1] &= ~white[1:]
    return np.flatnonzero((starts & ~joined) | last)


def unpacked(values: pa.BinaryArray) -> list[bytes]:
    """The values, none of them null, by their offsets."""
    _, offsets, data = values.buffers()
    bounds, raw = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist(), data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def odd(data: bytes) -> bool:
    return bool(data.translate(None, _EVEN_BYTES)) or b"\xC3\x97" in data or b"\xC3\xB7" in data


class Known(dict):
    """What each pre-token, as bytes, gives; at REMEMBERED it starts anew from the given ones."""

    def __init__(self, give, given: dict) -> None:
        super().__init__(given)
        self.give, self.given = give, given

    def __missing__(self, pre_token: bytes):
        if len(self) >= REMEMBERED + len(self.given):
            self.clear()
            self.update(self.given)
        self[pre_token] = found = self.give(pre_token)
        return found

    def values_of(self, texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """For plain, non-empty texts: the pre-tokens before the end of each, all pre-tokens as codes, and what each code gives."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        docs = np.cumsum(sizes) - sizes
        starts = cut_plain(np.frombuffer(joined, np.uint8), docs, words)
        offsets = pa.py_buffer(np.append(starts, len(joined)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        values = [self[x] for x in unpacked(coded.dictionary)]
        return np.searchsorted(starts, docs + sizes), coded.indices.to_numpy(), values


#: Bytes of plain text that are cut together.
SLICE = 2_000_000


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[list[int]]:
    """The places of the texts, in parts of about so many bytes."""
    part, n = [], 0
    for k, x in enumerate(texts):
        part.append(k)
        n += len(x)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


@cache
def _counter(path: str, whole: frozenset[str]) -> tuple[Merger, Known]:
    merger = Merger(path)
    count = lambda x: 0 if x[0] in b" \t\n\r\v\f" else len(merger.ids(x))
    return merger, Known(count, dict.fromkeys((x.encode() for x in whole), 1))


def count_tokens(texts: list[str], path: str, whole: frozenset[str]) -> np.ndarray:
    """The tokens of each text."""
    merger, known = _counter(path, whole)
    out, plain = np.zeros(len(texts), np.int64), []
    lowered = []
    for k, text in enumerate(texts):
        if not merger.usual(text):
            out[k] = sum(1 if special >= 0 else sum(map(known.__getitem__, found)) for special, found in merger.cut(text))
        elif odd(low := text.lower().encode()):
            out[k] = sum(known[x.encode()] for x in WORD_PATTERN.findall(text.lower()))
        elif low:
            plain.append(k)
            lowered.append(low)
    for part in slices(lowered):
        ends, codes, values = known.values_of([lowered[k] for k in part], True)
        total = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[codes])])
        out[[plain[k] for k in part]] = np.diff(np.concatenate([[0], total[ends]]))
    return out


def packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@cache
def _coder(path: str) -> tuple[Merger, Known]:
    merger = Merger(path)
    return merger, Known(lambda x: packed(merger.ids(x)), {})


def encode(texts: list[str], path: str) -> Iterator[tuple[int, memoryview | bytes]]:
    """(place, ids as little-endian unsigned 32-bit bytes) of each text, by a byte-level tokenizer file; in any order."""
    merger, known = _coder(path)
    plain, raw, size = [], [], 0
    for k, text in enumerate(texts):
        if not merger.usual(text):
            yield k, b"".join(packed([special]) if special >= 0 else b"".join(map(known.__getitem__, found)) for special, found in merger.cut(text))
        elif not (data := text.encode()) or odd(data):
            yield k, b"".join(known[x.encode()] for x in BYTE_PATTERN.findall(text))
        else:
            plain.append(k)
            raw.append(data)
            size += len(data)
            if size >= SLICE:
                yield from _encoded(plain, raw, known)
                plain, raw, size = [], [], 0
    if raw:
        yield from _encoded(plain, raw, known)


def _encoded(places: list[int], raw: list[bytes], known: Known) -> Iterator[tuple[int, memoryview]]:
    """The ids of plain, non-empty texts with these places."""
    ends, codes, values = known.values_of(raw, False)
    sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
    ids, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[codes]
    after = np.cumsum(n, dtype=np.int32)  # at most the bytes of the texts
    at = np.repeat(first[codes] - (after - n), n)
    at += np.arange(after[-1], dtype=np.int32)
    flat = memoryview(ids[at].tobytes())
    del at
    start = 0
    for k, end in zip(places, (4 * after[ends - 1].astype(np.int64)).tolist()):
        yield k, flat[start:end]
        start = end


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row of docs: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    path: a word-level tokenizer file, at the same place on every machine. A null text
    counts as empty, with no tokens; a null id stays null; repeated rows each get their
    row; an empty table gives an empty result; other columns are ignored. One map over
    the rows; a task holds REMEMBERED pre-tokens at most.
    """
    spark: SparkSession = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven_whole(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_tokens(batch.column(2).to_pylist(), path, whole.value))], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
