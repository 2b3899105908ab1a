"""Queries of the operators that compare rows with one another, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embeddings import near_vectors
from .jaccard import jaccard_components
from .passages import repeated_passages
from .registry import query

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k : array_to_string(w[k:k + 2], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(c) FROM r WHERE r.d = s.doc_id) AS component_id FROM s"""


@query(JACCARD_SQL)
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), n=3, percent=90)


@query()
def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"), words=50, similarity=0.8)


VECTORS_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(d, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links,
  (SELECT min(c) FROM r WHERE r.d = v.vec_id) AS component_id,
  (SELECT min(c) FROM r WHERE r.d = v.vec_id) = vec_id AS kept FROM v"""


@query(VECTORS_SQL)
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), cosine=0.9)
