"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document on its own, so the verdict does not depend on their
order. The order is chosen for cost: on a bounded sample every rule is timed, less the
time of a rule that does nothing, and which rules reject a row is counted together. Rules run by rejected documents per second, best first, where only
documents count that the rules before let pass. The cascade is one CASE expression, so
a rule's expression is evaluated only where all before it passed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import where_late

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: Times that a rule is timed, and the share of a second that is told apart.
RUNS, TICK = 3, 0.02


@dataclass(frozen=True)
class Rule:
    """fails: true for a document to reject, from the columns text and words."""

    name: str
    fails: Callable[[], Column]


def _n() -> Column:
    return F.size("words")


def _share(part: Column, whole: Column, most: float) -> Column:
    return (whole > 0) & (part > most * whole)


#: A letter, in the sense of Unicode.
LETTER = r"\p{L}"
RULES = (
    Rule("mean_word_length", lambda: ~F.char_length(F.array_join("words", "")).between(1.5 * _n(), 25 * _n())),
    Rule("symbols", lambda: _share(n_symbols(), _n(), 0.5)),
    Rule("letterless_words", lambda: _share(_n() - F.size(F.filter("words", lambda w: w.rlike(LETTER))), _n(), 0.7)),
    Rule("duplicate_lines", lambda: _share(n_dup_lines(), F.size(lines()), 0.5)),
    Rule("bullet_lines", lambda: (F.size(lines()) >= 4) & _share(F.size(F.filter(lines(), lambda x: x.rlike(r"^\s*[-*•]"))), F.size(lines()), 0.9)),
    Rule("ellipsis_lines", lambda: (F.size(lines()) >= 4) & _share(F.size(F.filter(lines(), lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), F.size(lines()), 0.5)),
)
#: The share of symbols in the words above which keep_good rejects. RULES, which op8 and its SQL share, has 0.5: a sign
#: between every two words stays just below that.
MOST_SYMBOLS = 0.1
KEEP_RULES = tuple(Rule("symbols", lambda: _share(n_symbols(), _n(), MOST_SYMBOLS)) if rule.name == "symbols" else rule for rule in RULES)


def n_symbols() -> Column:
    return F.char_length(F.regexp_replace("text", SYMBOLS, ""))


def lines() -> Column:
    """The lines that have a word."""
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))


def n_dup_lines() -> Column:
    return F.size(lines()) - F.size(F.array_distinct(lines()))


def with_words(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """kept (a struct of the given columns), text (null: empty) and words."""
    kept = F.struct(*[F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)])
    text = docs.select(kept.alias("kept"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))


def with_repeats(worded: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words within 5-word windows that occur twice or more.

    Windows are compared by their 64-bit hashes, and those of equal hashes by their words.
    Only a text in which some hash occurs twice is sorted, so most texts cost one pass;
    time is n log n at worst.
    """
    n = F.size("words")
    spots = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(spots, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))
    found = worded.withColumn("windows", F.when(n >= WINDOW, hashed))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("pairs", F.when(F.col("windows").isNotNull() & repeats, pairs))
    words = lambda e: F.slice("words", e["i"] + 1, WINDOW)
    same = lambda e, other: F.coalesce(F.when(other["h"] == e["h"], words(other) == words(e)), F.lit(False))
    twice = F.filter("pairs", lambda e, i: same(e, F.get("pairs", i - 1)) | same(e, F.get("pairs", i + 1)))
    found = found.withColumn("spots", F.sort_array(F.transform(twice, lambda e: e["i"])))
    steps = F.transform("spots", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("spots", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "pairs", "spots")


def cascade_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules by rejections per second on a random sample of about sample_rows rows, each by what those before it let pass.

    The sample decides the order alone, never a verdict. An empty table keeps the given
    order. The sampled rows are one partition, so a rule is
    timed in one task, over as many copies of them as make up sample_rows.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    few = docs.select(F.col(f"`{text_col}`").alias("text")).sample(share, seed=1).repartition(1)
    few = with_words(few, keep=[]).select("text", "words").persist()
    try:
        verdicts = few.select(F.concat(*[F.when(F.coalesce(rule.fails(), F.lit(False)), "1").otherwise("0") for rule in rules]).alias("v")) if rules else few.select(F.lit("").alias("v"))
        counts = {r["v"]: r["count"] for r in verdicts.groupBy("v").count().collect()}  # at most two to the number of rules
        if not counts:
            return list(rules)
        times = -(-sample_rows // sum(counts.values()))
        copies = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def seconds(fails: Column) -> float:
            took = []
            for _ in range(RUNS):  # the first run also compiles
                start = time.perf_counter()
                copies.agg(F.count_if(fails)).collect()
                took.append(time.perf_counter() - start)
            return min(took)

        empty = seconds(F.col("copy") < 0)
        # Costs within a tick of each other count as equal; then the rule that comes first in the table goes first.
        cost = [1 + round(max(0.0, seconds(F.coalesce(rule.fails(), F.lit(False)) & (F.col("copy") > 0)) - empty) / TICK) for rule in rules]
    finally:
        few.unpersist()
    left, order = list(range(len(rules))), []
    while left:
        rejected = {k: sum(n for v, n in counts.items() if v[k] == "1") for k in left}
        best = max(left, key=lambda k: ((rejected[k] + 0.5) / cost[k], -k))
        order.append(rules[best])
        left.remove(best)
        counts = {v: n for v, n in counts.items() if v[best] == "0"}
    return order


def failed_rule(order: list[Rule]) -> Column:
    """The name of the first rule in this order that rejects, else null."""
    verdict = None
    for rule in order:
        verdict = F.when(rule.fails(), rule.name) if verdict is None else verdict.when(rule.fails(), rule.name)
    return verdict if verdict is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20, sample_rows: int = 2000) -> DataFrame:
    """Measures and verdict of every row, in no set order.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, failed_rule (null if kept or failed at the base) and kept. A null
    or empty text has no words and fails at the base. A null id stays null, repeated
    rows each get their row, an empty table gives an empty result, and other columns
    of the input are ignored. The only pass is a map: nothing is shuffled.
    """
    order = cascade_order(docs, text_col, rules, sample_rows)
    found = with_repeats(with_words(docs, text_col, [id_col]))
    found = found.withColumn("n_words", F.size("words").cast("long"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    found = found.withColumn("base_failed", base)
    found = found.withColumn("failed_rule", F.when(~F.col("base_failed"), failed_rule(order)))
    return found.select(
        F.col("kept")[id_col].alias(id_col),
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols().cast("long").alias("n_symbols"),
        n_dup_lines().cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        "failed_rule",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = KEEP_RULES, min_words: int = 10, max_repeat_percent: int = 20, sample_rows: int = 2000) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps with these rules; the bound of symbols is the stricter one."""
    order = cascade_order(docs, text_col, rules, sample_rows)
    found = with_repeats(with_words(docs, text_col))
    good = (F.size("words") >= min_words) & (100 * F.col("n_repeat_words") <= max_repeat_percent * F.size("words"))
    return where_late(found, good & failed_rule(order).isNull()).select("kept.*")


#: DuckDB SQL of op8 over the table documents.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), r AS (SELECT *, row_number() OVER () AS rid FROM w
), g AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM r WHERE len(words) >= 5)
), d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT rid, sum(least(5, nxt - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM d) GROUP BY rid
), m AS (
  SELECT r.doc_id, r.t, r.words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM r LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), v AS (
  SELECT *, NOT (
    (n_words > 0 AND NOT (word_chars / n_words BETWEEN 1.5 AND 25))
    OR (n_words > 0 AND n_symbols > 0.5 * n_words)
    OR (n_words > 0 AND len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 0.7 * n_words)
    OR (n_lines > 0 AND n_dup_lines > 0.5 * n_lines)
    OR (n_lines >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*\x{2022}]'))) > 0.9 * n_lines)
    OR (n_lines >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})\s*$'))) > 0.5 * n_lines)) AS good FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND good) AS kept FROM v
"""
