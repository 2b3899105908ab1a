"""Registered queries and the pipeline on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerwave.llm import queries
from ledgerwave.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.CHECKS) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, FOLDER))
        assert out.columns == docs.columns, name
        rows.append(out.count())
        docs = out
    assert rows == sorted(rows, reverse=True) and rows[2] < rows[1] and rows[-1] > 0.5 * rows[0]
    packed = stored(corpus_pipeline.packing(spark, docs, FOLDER))
    assert packed.select("doc_id").distinct().count() == rows[-1]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_odd_tables(spark, documents):
    text = " ".join(f"word{k} another{k} third{k}" for k in range(30))
    for docs in (documents([]), documents([None, "", text, text, text + " x"], ids=[1, 2, 3, 3, None], langs=["en"] * 5)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= 10 * docs.count(), name
    left = corpus_pipeline.near_duplicates(spark, documents([text, text, text], ids=[3, 3, 4]), FOLDER)
    assert [r.doc_id for r in left.collect()] == [3]


def test_near_duplicates_take_five_words_and_four_fifths(spark, documents):
    words = [f"word{k}" for k in range(100)]
    edited = ["changed" if k in (30, 70) else w for k, w in enumerate(words)]
    docs = documents([" ".join(words), " ".join(edited), " ".join(words[:60])])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()) == [0, 2]


def test_stages_keep_columns_of_any_name(spark, documents):
    """Columns named like those of the operators, and a map, come out as they went in."""
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(reversed(words)), " ".join(words[:50]), " ".join(words[::2] * 1), " ".join(words)]
    docs = documents(texts, ids=[1, 2, 3, 4, 1], langs=["en"] * 5).withColumns({
        "n_words": F.lit("n"), "lang_pred": F.lit(4.5), "kept": F.lit("k"), "base_failed": F.lit(1), "held_out": F.lit("h"),
        "tags": F.create_map(F.lit("a"), F.col("doc_id")), "component_id": F.lit("c"), "carried": F.lit(3)})
    for stage in (corpus_pipeline.language, corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.substrings):
        out = stage(spark, docs, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and all((r.score, r.n_words, r.lang_pred, r.kept, r.base_failed, r.held_out, r.component_id, r.carried) ==
                            (7, "n", 4.5, "k", 1, "h", "c", 3) and r.tags == {"a": r.doc_id} for r in rows)
