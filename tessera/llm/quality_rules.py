"""Heuristic quality rules as a short-circuit cascade (operator 8), in DataFrame functions only.

Each rule is a condition on the text alone that rejects a document. On a bounded sample of documents that pass the
base rule, each rule's cost is the least of several timed passes over it, less that of a pass without a rule; its
selectivity is its share of rejections among the documents that the rules before it leave. One CASE expression
then tests the rules by rejections per second, so a rejected document pays for no later rule. The order decides
cost only: the verdict is the same in any order, and no result shows the order.

Edge cases: null and empty texts have no words, fail the base rule and are not kept; repeated rows are judged
each; an empty table gives an empty table; a text of one very long word is one word.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_text

#: Fixed values of the word definition: the separators, and the characters that count as symbols.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows on which rules are timed (a documented bound; only the order of the rules depends on it).
SAMPLE_ROWS = 500
#: Timed passes over the sample for each rule.
REPEATS = 3


@dataclass(frozen=True)
class Rule:
    """A rule by name; reject is an SQL condition on a column named text, counted the same on the columns of base_statistics."""

    name: str
    reject: str
    counted: str = ""


#: Shares are of code points outside white space, or of lines that hold a word.
RULES = (
    Rule("symbols", "length(text) - length(translate(text, '#*$%&|<>', '')) > 0.04 * length(text)"),
    Rule("exclamation", "length(text) - length(translate(text, '!', '')) > 0.04 * length(text)"),
    Rule("shouting", "length(text) - length(regexp_replace(text, '\\\\p{Lu}', '')) > 0.3 * length(text)"),
    Rule("few_letters", "length(regexp_replace(text, '[^\\\\p{L}]+', '')) < 0.6 * length(regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', ''))", "length(regexp_replace(text, '[^\\\\p{L}]+', '')) < 0.6 * word_chars"),
    Rule("word_length", "length(regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', '')) NOT BETWEEN 2.5 * regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') AND 12 * regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')", "word_chars NOT BETWEEN 2.5 * n_words AND 12 * n_words"),
    Rule("duplicate_lines", "size(array_distinct(filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'))) < 0.5 * size(filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'))", "n_lines - n_dup_lines < 0.5 * n_lines"),
)


def _seconds(sample: DataFrame, reject: str) -> float:
    """The least time of REPEATS passes that evaluate a condition on every row of a cached sample."""
    least = float("inf")
    for _ in range(REPEATS):
        began = time.perf_counter()
        sample.agg(F.sum(F.expr(f"CASE WHEN {reject} THEN 1 ELSE 0 END"))).collect()
        least = min(least, time.perf_counter() - began)
    return least


def order_rules(rows: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what is left) for rows with the columns that the rules name, by rejections per second.

    Timed on a random sample of about sample_rows rows. The next rule is always the one that rejects most per
    second of the sampled rows that no rule before it rejects.
    """
    n = rows.count()
    sample = rows
    if n > sample_rows:
        sample = sample.sample(sample_rows / n, seed=8)
    sample = sample.cache()
    marks = F.concat(*(F.expr(f"CASE WHEN {r.reject} THEN '1' ELSE '0' END") for r in rules))
    left = [(r["m"], r["count"]) for r in sample.groupBy(marks.alias("m")).count().collect()]  # one row for each combination
    nothing = _seconds(sample, "length(text) < 0")
    cost = {r: max(_seconds(sample, r.reject) - nothing, 1e-4) for r in rules}
    sample.unpersist()
    order = []
    while len(order) < len(rules):
        total = max(1, sum(k for _, k in left))
        share = {r: sum(k for m, k in left if m[i] == "1") / total for i, r in enumerate(rules) if r not in [x[0] for x in order]}
        best = min(share, key=lambda r: (-share[r] / cost[r], cost[r], r.name))
        order.append((best, cost[best], share[best]))
        left = [(m, k) for m, k in left if m[rules.index(best)] == "0"]
    return order


def rejected(rules: list[Rule]) -> Column:
    """True where a rule rejects the column text; rules after the first that does are not evaluated."""
    out = F.when(F.expr(rules[0].reject), F.lit(True))
    for rule in rules[1:]:
        out = out.when(F.expr(rule.reject), F.lit(True))
    return out.otherwise(F.lit(False))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, symbol and repetition counts of whole texts, in one pass without a shuffle.

    Repeated three-word windows are found by sorting (hash, position) pairs inside the row, so the work of a
    document is n log n in its words. Windows are told apart by a 64-bit hash.
    """
    words = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    windows = words.withColumn(
        "sorted",
        F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")))),
    )
    same = lambda i, x: F.coalesce(F.get("sorted", i)["h"] == x["h"], F.lit(False))
    found = windows.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["p"])))
    n = F.size("at")
    overlap = F.aggregate(F.zip_with(F.slice("at", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("at", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0), 3 - (b - a))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return found.select(
        F.col("id").alias(id_col),
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))[0].alias("lines"),
        F.when(n > 0, 3 * n - overlap).otherwise(0).cast("long").alias("n_repeat_words"),
    ).withColumns({"n_lines": F.col("lines")["all"], "n_dup_lines": F.col("lines")["dup"]}).drop("lines")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base statistics with base_failed and kept: whether neither the base rule nor any other rejects the text."""
    base = base_statistics(docs, id_col, text_col).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # words and lines are counted already
    rules = tuple(Rule(r.name, r.counted or r.reject) for r in rules)
    n = docs.count()
    # a bounded sample, cached so that the filter on its statistics does not compute them again and again
    some = base_statistics(docs.sample(min(1.0, 2 * SAMPLE_ROWS / max(1, n)), seed=8), id_col, text_col).cache()
    order = [rule for rule, _, _ in order_rules(some.filter("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words"), rules)]
    some.unpersist()
    return base.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected(order)))
