"""Quality rules as a short-circuit cascade, ordered by what a rule rejects for what it costs.

Cost (seconds on a sample) and selectivity of each rule are measured on a bounded sample of the table; the cascade is
one CASE expression in order of rejection per cost, so a text that an early cheap rule rejects never reaches the dear
ones. The verdict is the same in any order: a text is kept if no rule rejects it.

Null and empty texts have no words; all counts are 0 and the base rule for short texts rejects them. Repeated rows
are judged alike. Other columns are not used.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import SPACES, WORD, bounded_sample, let, word_count
from stayflow.session import reliable_checkpoint

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text to drop; null counts as false."""

    name: str
    rejects: Column


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_count(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return let(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def repeated_words(text: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        """Sort windows by hash; equal neighbours are repeats; then add what each repeat covers beyond the next."""
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        equal = lambda a, k, e: F.coalesce(F.get(a, k)["h"] == e["h"], F.lit(False))
        repeats = let(ordered, lambda a: F.sort_array(F.transform(
            F.filter(a, lambda e, k: equal(a, k - 1, e) | equal(a, k + 1, e)), lambda e: e["i"])))
        reach = let(repeats, lambda p: F.transform(
            p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def of_words(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                             lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
        return F.when(F.size(words) < 3, 0).otherwise(counted)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).cast("long")


def measure(texts: DataFrame) -> DataFrame:
    """Add the base counts to rows with a column text that is not null."""
    text = F.col("text")
    return texts.withColumns({
        "n_words": word_count(text), "word_chars": word_chars(text), "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(text),
    })


def default_rules(text: Column) -> list[Rule]:
    """Rules beside the base ones; each looks at the whole text."""
    words = word_count(text)
    letters = word_chars(text)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        Rule("symbols", symbol_count(text) * 10 > words),
        Rule("word_length", (letters > 15 * words) | (letters < 2 * words)),
        Rule("capitals", upper * 2 > letters),
        Rule("repeated_lines", duplicate_lines(text) * 10 > line_count(text) * 3),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], key: Column, text_col: str = "text") -> list[Rule]:
    """The rules, which look at the column `text_col`, by rejection per cost, both measured on at most SAMPLE_ROWS rows spread over the table by hash."""
    name = "sample_key" if text_col != "sample_key" else "_sample_key"
    rows = docs.select(key.alias(name), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    sample = reliable_checkpoint(bounded_sample(rows, F.col(name), SAMPLE_ROWS))
    worth = []
    for rule in rules:
        begin = time.perf_counter()
        rejected, rows = sample.agg(F.count_if(rule.rejects), F.count("*")).first()
        seconds = time.perf_counter() - begin
        worth.append((-(rejected / max(rows, 1)) / seconds, rule))
    return [rule for _, rule in sorted(worth, key=lambda pair: pair[0])]


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null. Rules after it are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict
