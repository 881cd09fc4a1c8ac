"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text becomes 5-word hashes; of each 6 consecutive hashes the least is kept,
so any span of 10 words that two texts share leaves a common fingerprint. Training
and test fingerprints are joined, and each common one is extended word by word to
the whole span, which drops chance agreements of hashes. Items of fewer than 10
words have no such guarantee; for the (at most nine) lengths that occur, all
n-word hashes of the documents are joined instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, GRAM = 10, 5
#: A fingerprint holds 32 bits of hash above 31 bits of position, so the least one is the leftmost least.
PLACE_BITS = 31
#: Distinct benchmark fingerprints, and bytes of all their rows with the items' words, up to which they are sent to every
#: task; beyond either, both sides are shuffled. The rows of the result are the same.
LITERAL_PRINTS, BROADCAST_BYTES = 20_000, 32_000_000


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case; lower() is the same and faster for plain ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(words: str, n: int) -> Column:
    """Packed hash and place of every n-word gram; only for texts of n words or more."""

    def packed(i: Column) -> Column:
        hashed = F.hash(F.lit(n), *[F.get(words, i + j) for j in range(n)]).cast("long")
        return F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), PLACE_BITS).bitwiseOR(i.cast("long"))

    return F.transform(F.sequence(F.lit(0), F.size(words) - n), packed)


def _fingerprints(table: DataFrame, words: str, short: list[int], is_item: bool) -> DataFrame:
    """Adds prints: winnowed ones of texts of SPAN words or more, and those for short items."""
    size, ahead = F.size(words), SPAN - GRAM + 1
    table = table.withColumn("grams", F.when(size >= SPAN, _grams(words, GRAM)))
    least = F.transform(F.sequence(F.lit(0), F.size("grams") - ahead), lambda i: F.least(*[F.get("grams", i + j) for j in range(ahead)]))
    none = F.array().cast("array<bigint>")
    parts = [F.when(F.col("grams").isNotNull(), F.array_distinct(least)).otherwise(none)]
    parts += [F.when((size == n) if is_item else (size >= n), _grams(words, n)).otherwise(none) for n in short]
    return table.withColumn("prints", F.concat(*parts)).drop("grams")


def _hash(packed: str) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int")


def _agreeing(step: int) -> Column:
    """Words next to the common print that agree, from its first word on (step 1) or before it (step -1)."""
    first = 0 if step > 0 else 1
    far = F.least(F.size("near") - F.col("near_at"), F.size("item_near") - F.col("item_at")) if step > 0 else F.least("near_at", "item_at")
    same = F.transform(F.sequence(F.lit(first), far - 1 + first), lambda j: F.get("near", F.col("near_at") + step * j) == F.get("item_near", F.col("item_at") + step * j))
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(far <= 0, F.lit(0)).when(stop == 0, far).otherwise(stop - 1)


def _spot(words: str, packed: Column) -> tuple[Column, Column]:
    """The words around a print, SPAN - GRAM before it and SPAN from it on, and where they begin in the text."""
    place = packed.bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int")
    from_ = F.greatest(F.lit(0), place - (SPAN - GRAM))
    return F.slice(words, from_ + 1, place - from_ + SPAN), from_


def item_prints(bench: DataFrame, short: list[int]) -> DataFrame:
    """(item, h, need, item_near, item_at): each print of the items (item, item_words), the words around it, and how many have to agree.

    A print carries SPAN words and a few, however long its item, so rows grow with the item's length.
    """
    prints = _fingerprints(bench, "item_words", short, True)
    spots = F.transform("prints", lambda p: F.struct(p.alias("p"), _spot("item_words", p)[0].alias("near"), _spot("item_words", p)[1].alias("from")))
    # explode_outer: from explode() Spark infers a filter, which it would push down with the whole expression.
    found = prints.select("item", F.least(F.lit(SPAN), F.size("item_words")).alias("need"), F.explode_outer(spots).alias("s")).where(F.col("s").isNotNull())
    return found.select("item", _hash("s.p").alias("h"), "need", F.col("s.near").alias("item_near"), (_place("s.p") - F.col("s.from")).alias("item_at"))


def shared_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", literal_prints: int = LITERAL_PRINTS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per row of docs: id, n_words, spans and items.

    spans holds shared spans [start, end) in words, sorted and distinct, whose union is
    every word of a shared window; items the distinct item ids. A window of SPAN words
    holds a common print, so a print is extended by SPAN - GRAM words each way at most.
    Items with null ids or without words match nothing.
    """
    bench = items.select(F.col(f"`{item_id}`").alias("item"), words_of(F.col(f"`{item_text}`")).alias("item_words"))
    bench = bench.where(F.col("item").isNotNull() & (F.size("item_words") > 0))
    lengths = bench.select(F.size("item_words").alias("n")).where(F.col("n") < SPAN).distinct().collect()
    short = sorted(x["n"] for x in lengths)

    tests = staged(item_prints(bench, short), "item-prints")
    size = tests.agg(F.sum(F.aggregate("item_near", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16) + 32).alias("bytes")).first()
    hashes = [x["h"] for x in tests.select("h").distinct().limit(literal_prints + 1).collect()] if (size["bytes"] or 0) <= broadcast_bytes else None
    small = hashes is not None and len(hashes) <= literal_prints

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    if small:
        found = _fingerprints(base, "words", short, False)
        found = found.withColumn("hot", F.filter("prints", lambda p: F.shiftright(p, PLACE_BITS).isin(hashes)) if hashes else F.array().cast("array<bigint>")).drop("prints")
        found = _extended(found, F.broadcast(tests), True)
    else:  # Only prints and places are shuffled; what they match goes back to the words. Documents without a match stay out of the joins.
        base = staged(base, "words")
        hot = _fingerprints(base, "words", short, False).select("row", F.explode_outer("prints").alias("p")).where(F.col("p").isNotNull()).withColumn("h", _hash("p"))
        hot = hot.join(tests.select("h").distinct(), "h", "left_semi").groupBy("row").agg(F.collect_list("p").alias("hot"))
        found = _extended(base.join(hot, "row"), tests, False)
        own = base.select("row", "id", F.size("words").alias("n_words"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("span", "item")])
        found = own.unionByName(found)
    return found.groupBy("row", "id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("item").alias("items")).drop("row")


def _extended(found: DataFrame, tests: DataFrame, own: bool) -> DataFrame:
    """(row, id, n_words, span, item) for each hit of the prints `hot` in `words`; with own a row without a hit for each document too, which only alone has n_words."""
    spots = F.transform("hot", lambda p: F.struct(p.alias("p"), _spot("words", p)[0].alias("near"), _spot("words", p)[1].alias("from")))
    if own:  # No print is negative: -1 stands for the document itself.
        spots = F.concat(F.array(F.struct(F.lit(-1).cast("bigint").alias("p"), F.array().cast("array<string>").alias("near"), F.lit(0).alias("from"))), spots)
    found = found.select("row", "id", F.size("words").alias("n_words"), F.explode_outer(spots).alias("spot"))
    found = found.select("row", "id", "n_words", "spot.near", "spot.from", F.when(F.col("spot.p") >= 0, F.shiftright("spot.p", PLACE_BITS)).alias("h"), (_place("spot.p") - F.col("spot.from")).alias("near_at"), (F.col("spot.p") < 0).alias("own"))
    found = found.join(tests, "h", "left").where(F.col("own") | F.col("item").isNotNull()) if own else found.join(tests, "h")
    found = found.withColumns({"back": F.when(~F.col("own"), _agreeing(-1)), "ahead": F.when(~F.col("own"), _agreeing(1))})
    hit = F.col("back") + F.col("ahead") >= F.col("need")
    at = F.col("from") + F.col("near_at")
    span = F.struct((at - F.col("back")).alias("start"), (at + F.col("ahead")).alias("end"))
    return found.where(F.col("own") | hit).select("row", "id", F.when(F.col("own"), F.col("n_words")).alias("n_words"), F.when(hit, span).alias("span"), F.when(hit, F.col("item")).alias("item"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", literal_prints: int = LITERAL_PRINTS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A null or empty text has no words and no hit; a null id stays null; repeated rows
    each get their row; either table may be empty; other columns are ignored. Equal
    items count apart, by their ids.
    """
    found = shared_spans(docs, items, id_col, text_col, item_id, item_text, literal_prints, broadcast_bytes)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
    )["n"]
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def clean_only(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have no shared span.

    Rows are told apart by a key that is written with them, so rows that share an id, or
    have none, each stand or fall by their own text.
    """
    row = free_name(docs, "row")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = decontaminate(keyed, items, row, text_col)
    bad = staged(found.where("contaminated").select(row), "contaminated")
    return keyed.join(bad, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of op10 over the tables documents and benchmark.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""
