"""Ranked lexical search: the best documents for each item by integer term weights.

Tasks hold ranges of the documents. For a part of its range a task concatenates, for every
item and each of its terms, the postings of that term, as pairs of a packed key (item,
document) and an impact; sorts them by radix, sums the impacts of equal keys, and keeps the
best of each item in a heap. The heaps of all ranges are merged by a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, lowered, members, ranges, words
from .common import discard, new_folder, table_at

#: Fixed: all ASCII but digits and letters stands between terms.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Items are searched in blocks of about so many (item, term) rows and bytes of terms; a block is broadcast.
BLOCK_ROWS, BLOCK_BYTES = 2_000_000, 32_000_000
#: Keys that are sorted at once; one item's may be more.
SORTED = 4_000_000
#: In the statistics, beside the numbers of terms: documents with a term, and all terms of documents.
N_DOCS, N_TERMS = -1, -2


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """Rows item, term: the distinct terms of each row of items, which has its number in `item`."""
    between = members(BETWEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = words(chunk, lowered(chunk.data), between)
                coded = found.values.dictionary_encode()
                both = np.unique(found.doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
                doc, code = np.divmod(both, max(1, len(coded.dictionary)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + chunk.first)), coded.dictionary.take(pa.array(code)).cast(pa.string())], names=["item", "term"])

    return items.select("item", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(run, "item long, term string")


class Index(NamedTuple):
    """The items of a block: their distinct terms, and for item k the terms of[first[k] : first[k + 1]] by their places."""

    items: np.ndarray
    vocabulary: pa.Array
    first: np.ndarray
    of: np.ndarray


def index(table: pa.Table) -> Index:
    """From rows item, term."""
    coded = table.column("term").combine_chunks().cast(pa.large_binary()).dictionary_encode()
    item = table.column("item").to_numpy()
    order = np.argsort(item, kind="stable")
    items, first = np.unique(item[order], return_index=True)
    return Index(items, coded.dictionary, np.append(first, len(item)), coded.indices.to_numpy()[order])


class Postings(NamedTuple):
    """Of the documents of a chunk: how many terms each has, and for each posting its term, document and count, sorted by term."""

    n: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def postings(chunk: Chunk, vocabulary: pa.Array, between: np.ndarray) -> Postings:
    found, n_docs = words(chunk, lowered(chunk.data), between), chunk.last - chunk.first
    term = pc.index_in(found.values, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
    known = term >= 0
    both, tf = np.unique(term[known] * n_docs + found.doc[known], return_counts=True)
    return Postings(np.bincount(found.doc, minlength=n_docs), *np.divmod(both, n_docs), tf)


def statistics(docs: DataFrame, vocabulary) -> dict[int, int]:
    """For each term of the broadcast vocabulary the documents that hold it, and N_DOCS and N_TERMS, over all documents."""
    between = members(BETWEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, total = np.zeros(len(known), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = postings(chunk, known, between)
                df += np.bincount(found.term, minlength=len(known))
                total += np.count_nonzero(found.n), found.n.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [N_DOCS, N_TERMS])), pa.array(np.append(df[some], total))], names=["term", "n"])

    return {row["term"]: row["n"] for row in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def by_radix(keys: np.ndarray) -> np.ndarray:
    """The order of non-negative keys: by their digits of 16 bits, the lowest first, each by numpy's stable (radix) sort."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while int(keys.max(initial=0)) >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulated(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the impacts of each."""
    order = by_radix(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(impacts[order], first) if len(first) else np.zeros(0, np.int64)


class Best:
    """The k best documents of each item so far, as (-score, id is not null, id)."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.found = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a score of 0 is no result

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """item: in order. ids: of the documents."""
        keep = score >= self.least[item]
        item, doc, score = item[keep], doc[keep], score[keep]
        begins = np.flatnonzero(np.diff(item, prepend=-1)).tolist()
        for k, begin, end in zip(item[begins].tolist(), begins, [*begins[1:], len(item)], strict=True):
            part, of = score[begin:end], doc[begin:end]
            if len(part) > self.k:
                enough = part >= np.partition(part, -self.k)[-self.k]
                part, of = part[enough], of[enough]
            new = ((-s, x is not None, x) for s, x in zip(part.tolist(), ids.take(pa.array(of)).to_pylist(), strict=True))
            self.found[k] = best = heapq.nsmallest(self.k, [*self.found[k], *new])
            if len(best) == self.k:
                self.least[k] = -best[-1][0]


def ranked(docs: DataFrame, items, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Rows item, doc_id, score: the k best of each item in each range of docs (doc_id, text). items, weights: broadcasts."""
    between = members(BETWEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = items.value, weights.value
        best, kind = Best(len(block.items), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for chunk in chunks(batch.column(1)):
                found = postings(chunk, block.vocabulary, between)
                m = 100 - 90 + 90 * found.n * n_docs // max(1, n_terms)
                impact = weight[found.term] * (1_000_000_000 * found.tf // (1000 * found.tf + 8 * m[found.doc]))
                sizes = np.bincount(found.term, minlength=len(weight))
                firsts, ids = np.cumsum(sizes) - sizes, batch.column(0).slice(chunk.first, chunk.last - chunk.first)
                after = np.concatenate([[0], np.cumsum(sizes[block.of])])[block.first]  # keys before each item's end
                lo = 0
                while lo < len(block.items):
                    hi = max(lo + 1, int(np.searchsorted(after, after[lo] + SORTED, "right")) - 1)
                    terms = block.of[block.first[lo] : block.first[hi]]
                    posting = ranges(firsts[terms], sizes[terms])
                    item = np.repeat(np.arange(hi - lo), np.diff(after[lo : hi + 1]))
                    keys, score = accumulated(item * len(ids) + found.doc[posting], impact[posting])
                    if len(keys):
                        item, doc = np.divmod(keys, len(ids))
                        best.add(item + lo, doc, score, ids)
                    lo = hi
        rows = [(int(block.items[at]), x, -s) for at, found in enumerate(best.found) for s, _, x in found]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, f"item long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of items its k best documents: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case. With N
    documents that have a term, L terms in them all, n in one of them and df documents that
    hold a term, the term weighs floor(1000 * ln((2N + 2) / (2df + 1))), and a document
    scores weight * (10**9 * tf div (1000 * tf + 8 * m)) summed over the item's distinct
    terms, m being 10 + 90 * n * N div L. Scores above 0 are ranked; equal ones by id, null first.

    A null text has no terms; an item without any has no rows, nor have any without
    documents; each of repeated rows counts and is ranked on its own; other columns are
    ignored; texts count whole. Items go in blocks of bounded size, each broadcast, against
    all documents, which are read twice for a block. A task sends k rows an item at most.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "search")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    numbered = table_at(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")), f"{folder}-items")
    terms = table_at(item_terms(numbered, "text"), f"{folder}-terms")
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    n_blocks = 1 + max(size["n"] // BLOCK_ROWS, size["bytes"] // BLOCK_BYTES)
    out = None
    for number in range(n_blocks):
        block = index(terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == number).toArrow())
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        known = statistics(slim, vocabulary)
        n_docs, n_terms = known.pop(N_DOCS, 0), known.pop(N_TERMS, 0)
        df = np.zeros(len(block.vocabulary), np.int64)
        df[[*known]] = [*known.values()]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        found = ranked(slim, spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(weights), n_docs, n_terms, k)
        out = found if out is None else out.unionByName(found)
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    done = table_at(best.join(numbered.select("item", "item_id"), "item").select(F.col("item_id").alias(item_id_col), "rank", F.col("doc_id").alias(id_col), "score"), f"{folder}-found")
    discard(f"{folder}-terms")
    discard(f"{folder}-items")
    return done


#: The rows of `search` over documents and benchmark.
SQL = """
WITH doc_terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tfs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
ns AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS MATERIALIZED (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM ns),
weights AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, n_docs),
item_terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
impacts AS MATERIALIZED (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS impact FROM tfs JOIN ns USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
