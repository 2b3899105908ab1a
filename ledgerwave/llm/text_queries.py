"""Queries of the operators that judge or search texts one by one, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .languages import learn, predict
from .licences import scan
from .quality import apply_rules
from .registry import query

QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT *, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines FROM s),
wins AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM m)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM again, range(0, 8) r(o) GROUP BY doc_id),
b AS (SELECT m.*, coalesce(n, 0) AS n_repeat_words,
        n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= 3 * n_words
  AND 10 * n_dup_lines <= 4 * len(l)
  AND 10 * length(regexp_replace(text, '\P{L}+', '', 'g')) >= 5 * word_chars
  AND 10 * length(regexp_replace(text, '\P{Lu}+', '', 'g')) <= 5 * word_chars AS kept
FROM b"""


@query(QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs.select("doc_id", "text"), learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
