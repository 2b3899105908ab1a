"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document.  On a bounded sample each rule's time and share of rejected rows are measured; the rules
then run in order of rejection per cost, each only on rows that passed those before (CASE evaluates no further
branch once one holds).  The order changes the work, never the verdict."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """name, the condition under which it rejects, a true or false or null (does not reject) of measured columns."""

    name: str
    rejects: Column


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paired(step: int):
    """Hashes of each element with the one `step` places on."""
    return lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - step - 1),
                                 lambda k: F.xxhash64(F.get(h, k), F.get(h, k + step)))


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in the array, the first time included.

    Windows are compared by 64-bit hashes.  Without a repeated hash that is all; else hashes are sorted with their
    places, and the places of repeated ones cover words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # of single words, pairs, fours and eights
        hashes = bound(hashes, paired(step))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        again = bound(pairs, lambda s: F.filter(s, lambda p, k: (F.get(s, k - 1)["h"] == p["h"]).eqNullSafe(True)
                                                | (F.get(s, k + 1)["h"] == p["h"]).eqNullSafe(True)))
        places = F.array_sort(F.transform(again, lambda p: p["k"]))
        return F.aggregate(
            places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, k: F.struct(k.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), k - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(bound(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bullets, n_shouted (long).

    A null text has no words.  All rows stay, repeated ones too; a column of docs with one of these names is
    replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    count = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeated_words(F.col("__words")),
        "n_lines": F.size("__lines"),
    }
    held = docs.withColumns({"__words": words, "__lines": lines})
    return held.withColumns({k: v.cast("long") for k, v in count.items()}).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    words = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * words),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 4 * F.col("n_lines")),
        Rule("letters", 10 * F.length(F.regexp_replace("text", r"\P{L}+", "")) < 5 * F.col("word_chars")),
        Rule("shouting", 10 * F.length(F.regexp_replace("text", r"\P{Lu}+", "")) > 5 * F.col("word_chars")),
    ]


def cascade_order(measured_docs: DataFrame, rules: Sequence[Rule], rows: int = 500,
                  longest: int = 20_000) -> list[Rule]:
    """Rules by rejected share per second on `rows` rows of texts of at most `longest` characters, best first.

    The sample only orders the rules.  Without rows, or between equal scores, the given order stays."""
    spark = measured_docs.sparkSession
    inputs = measured_docs.where(F.length("text") <= longest)
    sample = inputs.limit(rows).collect()
    if not sample:
        return list(rules)
    held = spark.createDataFrame(sample, inputs.schema).repartition(1).persist()
    try:
        held.count()
        score = []
        for k, rule in enumerate(rules):
            began = time.perf_counter()
            hit = held.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long"))).first()[0] or 0
            score.append((-hit / len(sample) / (time.perf_counter() - began), k))
    finally:
        held.unpersist()
    return [rules[k] for _, k in sorted(score)]


def verdict(ordered: Sequence[Rule]) -> Column:
    """True unless a rule rejects; rules after the first that does are not evaluated."""
    out = None
    for rule in ordered:
        out = F.when(rule.rejects, False) if out is None else out.when(rule.rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """docs with the measures, base_failed and kept.  Every row stays; null and empty texts fail the base."""
    rows = measured(docs)
    ordered = cascade_order(rows, rules or default_rules())
    rows = rows.withColumn("base_failed", base_failed())
    return rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(ordered)))


def passing(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of docs that are kept.  They are picked by a generator, below which the optimizer moves no
    expression: a filter would evaluate the measures once more for each of their uses."""
    rows = apply_rules(docs, rules)
    return rows.withColumn("__kept", F.explode(F.when(F.col("kept"), F.array(F.lit(1))))).select(docs.columns)
