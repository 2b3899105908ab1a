"""Queries of vector codes, page texts and collocations, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table
from .page_text import page_texts
from .registry import query
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def codes_sql() -> str:
    """Each round compares all parts with all entries of their codebook."""
    def nearest(k):
        return f"""a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, p.q, min(d * {ENTRIES} + entry) AS best FROM (
  SELECT p.vec_id, p.part, p.q, b.entry, CAST(list_sum(list_transform(range(1, len(p.q) + 1),
    lambda i : (p.q[i] - b.q[i]) * (p.q[i] - b.q[i]))) AS HUGEINT) AS d FROM parts p JOIN b{k} b USING (part)) p
  GROUP BY p.vec_id, p.part, p.q)"""

    def moved(k):
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(v ORDER BY i) AS q FROM (
    SELECT part, best % {ENTRIES} AS entry, i, CAST(floor(sum(q[i])::HUGEINT::DOUBLE / count(*)) AS BIGINT) AS v
    FROM a{k}, range(1, 17) r(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""

    steps = ",\n".join(f"{nearest(k)},\n{moved(k)}" for k in range(ROUNDS))
    return f"""
WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda x : CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, q[1 + part * len(q) // {PARTS}:(part + 1) * len(q) // {PARTS}] AS q
  FROM good, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM parts
  QUALIFY entry < {ENTRIES}),
{steps},
{nearest(ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code,
  CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN good USING (vec_id), sha"""


@query(codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings"))


# The main text of the given pages is their article.
PAGES_SQL = r"""
WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'),
    '</?(p|h1)>') AS b FROM pages),
t AS (SELECT page_id, url, list_transform(b, lambda x : trim(regexp_replace(regexp_replace(replace(replace(replace(
    regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))) AS b FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(b, lambda x : x <> ''), chr(10)) AS text FROM t)"""


@query(PAGES_SQL)
def op12_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(table(spark, folder, "pages"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x : x <> '') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, len(g) AS k, count(*) AS a FROM (
  SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) s(k)))
  GROUP BY lang, g HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.g, c.a, j, x.a AS l, y.a AS r, 2000000 * c.a::HUGEINT // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]),
low AS (SELECT lang, g, a, arg_min(l, score * 4 + j) AS l, arg_min(r, score * 4 + j) AS r, min(score) AS score
  FROM cuts GROUP BY lang, g, a),
subs AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS top FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (
  SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN subs USING (lang, g) WHERE top IS NULL OR 100 * top < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM kept) JOIN n USING (lang)
QUALIFY rank <= 2000"""


@query(COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
