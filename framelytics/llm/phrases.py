"""Phrase collocations: the n-grams of each language that occur together more often than their parts suggest.

N-grams of 1 to max_n words are exploded into rows, which are counted by language. An n-gram
can only be frequent if the shorter ones inside it are, so explosion goes in rounds: words;
pairs of frequent words, as hashes, which only tell which pairs may be frequent; then all
n-grams of two words and more whose pairs may be, with exact counts. What a round leaves out
could not have reached min_count; a Sieve of fixed size carries the frequent parts to the
tasks and lets some others pass, which the exact counts then drop. Texts go to Python and
are exploded PART bytes at a time, as the arrays take some 50 bytes for each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, lowered, members, words
from .common import discard, new_folder, sent_in_parts, staged, table_at

#: The fixed separators: of words, and of the pieces that no phrase crosses.
SPACES, BREAKS = b"\t ", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text that are exploded at once, a longer text being cut where a piece ends, and that are sent at once: with the last row mostly a part.
PART, SENT = 1_200_000, 900_000
#: Bits of a hash that is counted, and of a Sieve, which is 2 ** SIEVE_BITS bits: 8 MB.
KEY_BITS, SIEVE_BITS = 40, 26
#: Multiplies the hash of a word before the next one's is added.
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_keys(langs: list[str], texts: list[bytes]) -> np.ndarray:
    """The hash of each word of a language."""
    return np.fromiter((xxhash.xxh64_intdigest(text, xxhash.xxh32_intdigest(lang)) for lang, text in zip(langs, texts, strict=True)), np.uint64, len(texts)) >> np.uint64(64 - KEY_BITS)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two words by theirs."""
    both = (left * MIX + right) * MIX
    return (both ^ both >> np.uint64(31)) * MIX >> np.uint64(64 - KEY_BITS)


class Sieve:
    """A set of hashes as bits: what is in it passes, and little else while it is sparse."""

    def __init__(self, table: pa.Table) -> None:
        self.bits = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
        self.bits[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slots = keys >> np.uint64(KEY_BITS - SIEVE_BITS)
        return (self.bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve(keys: DataFrame) -> Sieve:
    """The Sieve of these keys (a column `key`); at most 2 ** (SIEVE_BITS - 6) rows of 64 bits reach the driver."""
    slot = F.shiftright("key", KEY_BITS - SIEVE_BITS)
    placed = keys.select(F.shiftright(slot, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(shiftright(key, {KEY_BITS - SIEVE_BITS}) & 63 AS int))").alias("bits"))
    return Sieve(placed.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())


class Part(NamedTuple):
    """The words of a chunk: the number of each, the text, language and hash of each number, and a piece that grows wherever one ends."""

    own: np.ndarray
    texts: pa.Array
    langs: np.ndarray
    keys: np.ndarray
    piece: np.ndarray


def cut(chunk: Chunk, breaks: np.ndarray) -> Iterator[Chunk]:
    """The chunk itself or, of one text of over PART bytes, parts that end after a break (256 flags); only a piece may be longer than PART."""
    if chunk.last - chunk.first > 1 or len(chunk.data) <= PART:
        yield chunk
        return
    ends = np.append(np.flatnonzero(breaks[chunk.data]) + 1, len(chunk.data))
    start = 0
    while start < len(chunk.data):
        at = int(np.searchsorted(ends, start + PART, "right"))
        end = int(ends[at - 1]) if at and ends[at - 1] > start else int(ends[at])
        yield Chunk(chunk.first, chunk.last, chunk.data[start:end], np.array([0, end - start]))
        start = end


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Of batches lang, text, both without nulls."""
    apart, breaks = members(SPACES + BREAKS), members(BREAKS)
    for batch in batches:
        languages = batch.column(0).dictionary_encode()
        names, of_row = np.array(languages.dictionary.to_pylist(), object), languages.indices.to_numpy().astype(np.int64)
        for chunk in (part for whole in chunks(batch.column(1), PART) for part in cut(whole, breaks)):
            data = lowered(chunk.data)
            found = words(chunk, data, apart)
            if len(found.at):
                coded = found.values.dictionary_encode()
                n_distinct = len(coded.dictionary)
                ids, own = np.unique(of_row[chunk.first + found.doc] * n_distinct + coded.indices.to_numpy(), return_inverse=True)
                texts, langs = coded.dictionary.take(pa.array(ids % n_distinct)), names[ids // n_distinct]
                yield Part(own, texts, langs, word_keys(langs.tolist(), texts.to_pylist()), np.cumsum(breaks[data], dtype=np.int32)[found.at] + found.doc)


def _rows(lang: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrase.cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def exploded_words(docs: DataFrame) -> DataFrame:
    """Rows lang, phrase, f: the words, counted within parts of a task; a row without phrase counts a language's words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            f = np.bincount(part.own)
            yield _rows(part.langs, part.texts, f)
            names, of = np.unique(part.langs.astype(str), return_inverse=True)
            yield _rows(names, pa.nulls(len(names), pa.large_binary()), np.bincount(of, f).astype(np.int64))

    return docs.mapInArrow(run, "lang string, phrase string, f long")


def hashed(words_: DataFrame) -> DataFrame:
    """Rows key of words lang, phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = word_keys(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], names=["key"])

    return words_.select("lang", "phrase").mapInArrow(run, "key long")


def exploded_pairs(docs: DataFrame, known) -> DataFrame:
    """Rows key, f: pairs of neighbours within a piece whose words both pass the broadcast Sieve, as hashes, counted within parts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            ok = known.value.passes(part.keys)[part.own]
            start = np.flatnonzero(ok[:-1] & ok[1:] & (part.piece[:-1] == part.piece[1:]))
            if len(start):
                keys, f = np.unique(pair_keys(part.keys[part.own[start]], part.keys[part.own[start + 1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(f)], names=["key", "f"])

    return docs.mapInArrow(run, "key long, f long")


def exploded_phrases(docs: DataFrame, max_n: int, known) -> DataFrame:
    """Rows lang, phrase, f: the n-grams of 2 to max_n words whose pairs all pass the broadcast Sieve, counted within parts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            own, gram = part.own, part.own.copy()  # gram: the number of the n-gram that starts at each word
            pairs = (part.piece[:-1] == part.piece[1:]) & known.value.passes(pair_keys(part.keys[own[:-1]], part.keys[own[1:]]))
            ok = pairs
            for n in range(2, max_n + 1):
                ok = ok[:-1] & pairs[n - 2 :] if n > 2 else ok
                start = np.flatnonzero(ok)
                if not len(start):
                    break
                _, first, gram[start], f = np.unique(gram[start] * len(part.texts) + own[start + n - 1], return_index=True, return_inverse=True, return_counts=True)
                first = start[first]
                yield _rows(part.langs[own[first]], pc.binary_join_element_wise(*(part.texts.take(pa.array(own[first + k])) for k in range(n)), pa.scalar(b" ", pa.large_binary())), f)

    return docs.mapInArrow(run, "lang string, phrase string, f long")


def counted(docs: DataFrame, max_n: int, min_count: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The frequent n-grams (lang, n_words, phrase, f), the words of each language (lang, n), and the folders they are in."""
    send, folders = docs.sparkSession.sparkContext.broadcast, [new_folder(docs.sparkSession, name) for name in ("words", "phrases")]
    total = exploded_words(docs).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words_ = table_at(total.where(F.col("phrase").isNull() | (F.col("f") >= min_count)), folders[0])
    frequent = words_.where(F.col("phrase").isNotNull())
    pairs = exploded_pairs(docs, send(sieve(hashed(frequent)))).groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    total = exploded_phrases(docs, max_n, send(sieve(pairs))).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    longer = table_at(total.where(F.col("f") >= min_count), folders[1])
    both = frequent.select("lang", "phrase", "f").unionByName(longer).select("lang", F.size(F.split("phrase", " ")).alias("n_words"), "phrase", "f")
    return both, words_.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")), folders


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, share: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are in lower case; pieces end at .,;:!? and line breaks, words at spaces and tabs.
    A candidate has 2 to max_n words and occurs a >= min_count times within pieces. A cut
    after its first k words gives l and r, the counts of both parts, and the score
    floor(1000 * a * n / (l * r)), n being the words of the language; its lowest cut counts,
    of equal ones that of the smallest k. A candidate goes if its words lie within a longer
    one that occurs at least share % as often: as counts only shrink as phrases grow, one
    more word at either end tells. Ranks go by score, a (both falling) and phrase.

    A null language is `und`, a null or empty text has no words, repeated rows count each,
    an empty table gives an empty result, other columns are ignored; a text counts whole.
    Counts are summed in parts of a task before they are shuffled. Joins of hot words are
    left to adaptive execution: both sides are tables.
    """
    text = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with sent_in_parts(docs.sparkSession, SENT):
        frequent, words_of, folders = counted(text, max_n, min_count)
    candidates = frequent.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    n_words = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, n_words - F.col("k")).alias("right"))
    counts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(words_of, "lang")
    number = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * number("a") * number("n")).cast("decimal(38,0)")).withColumn("below", (number("l") * number("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    ends = F.explode(F.array(part(F.lit(1), n_words - 1), part(F.lit(2), n_words - 1)))
    longer = candidates.where(n_words > 2).select("lang", ends.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.alias("s").join(longer.alias("x"), (F.col("s.lang") == F.col("x.lang")) & (F.col("s.phrase") == F.col("x.phrase")) & (100 * F.col("x.longer") >= share * F.col("s.a")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = staged(out, "collocations")
    for folder in folders:
        discard(folder)
    return out


def sql(max_n: int = 5, min_count: int = 100, share: int = 100, top: int = 2000) -> str:
    """The rows of `collocations` by DuckDB, from all n-grams of all documents."""
    leads = ", ".join(f"lead(w, {k - 1}) OVER p AS w{k}" for k in range(2, max_n + 1))
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS size, {' || chr(32) || '.join(f'w{k}' for k in range(1, n + 1))} AS phrase FROM leads WHERE w{n} IS NOT NULL" for n in range(1, max_n + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents),
pieces AS (SELECT row_number() OVER () AS piece, lang, string_split_regex(trim(text, chr(32) || chr(9)), '[\\x20\\x09]+') AS words FROM texts WHERE trim(text, chr(32) || chr(9)) <> ''),
words AS (SELECT piece, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces),
leads AS (SELECT lang, w AS w1, {leads} FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
grams AS ({grams}),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING size = 1 OR count(*) >= {min_count}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
sizes AS (SELECT range AS size FROM range(1, {max_n})),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k.size AS k, array_to_string(words[1:k.size], ' ') AS lhs, array_to_string(words[k.size + 1:c.size], ' ') AS rhs FROM candidates c JOIN sizes k ON k.size < c.size),
lefts AS MATERIALIZED (SELECT c.lang, c.phrase, c.a, c.k, c.rhs, x.f AS l FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lhs),
scores AS (SELECT c.lang, c.phrase, c.a, c.l, y.f AS r, n.n, c.k, ((1000::HUGEINT * c.a * n.n) // (c.l::HUGEINT * y.f))::BIGINT AS score FROM lefts c JOIN f y ON y.lang = c.lang AND y.phrase = c.rhs JOIN n ON n.lang = c.lang),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM least s WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.lang = s.lang AND len(b.phrase) > len(s.phrase) AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= {share} * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}
"""
