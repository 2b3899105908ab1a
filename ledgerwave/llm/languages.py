"""Language of a text by a string kernel.

Two texts are as similar as the number of byte n-grams (1 to 3, over a small alphabet) that both contain, over the
root of the product of their numbers.  A bounded labelled sample gives landmarks; Nystroem features against them and
one-versus-rest kernel ridge regression give a score per language.  The kernel is linear in the presence vectors, so
the products with landmarks and with the regression are one matrix, and a batch is scored by one product."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import filled, pieces_of, worker_cache

ORDERS = 3
#: Symbols: 0 for anything but letters, 1 to 26 for a to z in either case, then the bytes from 128 on.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[ord("a"):ord("z") + 1] = SYMBOL[ord("A"):ord("Z") + 1] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
BASE = 155
SPACE_OF = [0, BASE, BASE + BASE ** 2]  # where the codes of each order start
CODES = BASE + BASE ** 2 + BASE ** 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    grams: np.ndarray  # codes of the n-grams that count
    weights: np.ndarray  # n-grams x languages
    offset: np.ndarray


def gram_rows(texts: pa.Array):
    """(text, code) of every n-gram of every text, repeated ones too, by order."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    symbol = SYMBOL[data[at[0]:at[-1]]]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    code = symbol
    yield owner, code
    for n in range(2, ORDERS + 1):
        if len(symbol) < n:
            return
        code = code[:-1] * BASE + symbol[n - 1:]
        own = owner[:len(code)]
        inside = own == owner[n - 1:]
        yield own[inside], code[inside] + SPACE_OF[n - 1]


def presence(texts: pa.Array, place: np.ndarray, n: int) -> np.ndarray:
    """Texts x n-grams, 1 where a text contains it.  place: column of each code, n where it does not count."""
    out = np.zeros((len(texts), n + 1), np.float32)
    for owner, code in gram_rows(texts):
        out[owner, place[code]] = 1
    return out[:, :n]


def places(grams: np.ndarray) -> np.ndarray:
    place = np.full(CODES, len(grams), np.int32)
    place[grams] = np.arange(len(grams))
    return place


def normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def training_rows(docs: DataFrame, per_language: int, longest: int) -> list[tuple[str, str]]:
    """At most per_language (text, language) of each language, by the hash of doc_id: the classifier's bounded
    sample, from rows whose crc32(doc_id as text) mod 4 is not 2."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                      & F.col("doc_id").isNotNull())
    share = [(r.lang, min(1.0, 4 * per_language / r.n)) for r in rows.groupBy("lang").agg(
        F.count("*").alias("n")).collect()]
    if not share:
        return []
    limit = F.create_map(*[F.lit(x) for name, s in share for x in (name, int(s * 2 ** 31))])[F.col("lang")]
    h = F.hash(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 31) - 1))
    got = rows.where((h <= limit) & (F.length("text") <= longest)).select(
        "lang", "text", h.alias("h"), "doc_id").collect()
    seen: Counter = Counter()
    out = []
    for r in sorted(got, key=lambda r: (r.h, r.doc_id, r.text)):
        seen[r.lang] += 1
        if seen[r.lang] <= per_language:
            out.append((r.text, r.lang))
    return out


def held_out():
    """Rows kept from learning.  A null doc_id is held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def fit(rows: list[tuple[str, str]], landmarks: int = 160, ridge: float = 1e-3, least: int = 3) -> Model | None:
    """Landmarks are taken in turn from the languages; n-grams in fewer than `least` landmarks do not count."""
    rows = [r for r in rows if any(c.isalpha() for c in r[0])]
    if not rows:
        return None
    names = sorted({lang for _, lang in rows})
    texts = filled(pa.array([t for t, _ in rows], pa.large_string()))
    seen: Counter = Counter()
    turn = []  # how many rows of its language come before a row
    for _, lang in rows:
        turn.append(seen[lang])
        seen[lang] += 1
    order = sorted(range(len(rows)), key=turn.__getitem__)
    chosen = np.array(sorted(order[:landmarks]))
    found = np.zeros(CODES, np.int64)
    for owner, code in gram_rows(filled(texts.take(pa.array(chosen)))):
        for key in np.unique(owner.astype(np.int64) * CODES + code) % CODES:
            found[key] += 1
    grams = np.flatnonzero(found >= min(least, len(chosen)))
    rows_x = normed(presence(texts, places(grams), len(grams)).astype(np.float64))
    marks = rows_x[chosen]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])  # features are K(x, landmarks) root
    features = rows_x @ (marks.T @ root)
    target = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in rows])
    mean = target.mean(0)
    gram = features.T @ features + ridge * len(rows) * np.eye(features.shape[1])
    return Model(tuple(names), grams, (marks.T @ root @ np.linalg.solve(gram, features.T @ (target - mean))).astype(
        np.float32), mean.astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with held_out, lang_pred and score (0 to 1), for every row; columns of these names are replaced.

    A null text, or one without letters, is `und` with score 0; without a model every text is.  The score is
    the regression's value for the language, brought from [-1, 1] to [0, 1].  Equal values go to the language first
    in the alphabet.  Rows with null or repeated doc_id are predicted like others."""
    def run(batches):
        place = worker_cache("no model", lambda: None) if model is None else places(model.grams)
        for batch in batches:
            for rows in pieces_of(batch):
                texts = filled(rows.column("text"))
                known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                name, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model is not None and known.any():
                    at = np.flatnonzero(known)
                    own = filled(texts.take(pa.array(at)))
                    value = normed(presence(own, place, len(model.grams))) @ model.weights + model.offset
                    best = value.argmax(1)
                    name[at] = np.array(model.languages, object)[best]
                    score[at] = np.clip((value[np.arange(len(at)), best] + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(name, pa.string()), pa.array(score)],
                    [*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score").withColumn("held_out", held_out())
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def learn(docs: DataFrame, per_language: int = 400, longest: int = 20_000, **more) -> Model | None:
    return fit(training_rows(docs, per_language, longest), **more)
