"""Licence scans by a positional index of rare words.

Templates are word sequences.  Words weigh by their inverse document frequency in the scanned documents.  Where a
document holds one of a template's rarest words, the word's posting (template, position) gives the place where the
template would start; there all its words are compared at their positions, and its key phrases must stand complete.
Phrases of the base are found word by word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import filled, pieces_of

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases of the text that must be complete


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("source and binary forms",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted", "free of charge")),
)


def words_of(text: str) -> list[str]:
    return text.split()


class Index:
    """Vocabulary, templates as word numbers, postings of rare words.  weight: by word number."""

    def __init__(self, templates, phrases, weight=None, anchors: int = 3):
        known = {w for t in templates for w in words_of(t.text)} | {w for p in phrases for w in words_of(p)}
        self.words = sorted(known)
        number = {w: k for k, w in enumerate(self.words)}
        self.weight = np.ones(len(self.words)) if weight is None else weight
        self.phrases = [(label, np.array([number[w] for w in words_of(p)])) for p, label in phrases.items()]
        self.templates = []
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            own = np.array([number[w] for w in words_of(t.text)])
            must = np.zeros(len(own), bool)
            for key in t.keys:
                want = [number[w] for w in words_of(key)]
                at = next(i for i in range(len(own)) if own[i:i + len(want)].tolist() == want)
                must[at:at + len(want)] = True
            self.templates.append((t.label, own, must))
            rare = sorted(range(len(own)), key=lambda j: (-self.weight[own[j]], j))[:anchors]
            for j in rare:
                self.postings.setdefault(int(own[j]), []).append((k, j))


def word_numbers(texts: pa.Array, vocabulary: pa.Array):
    """(number or -1 of every word, first word of every text and the end)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ids = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[full]
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return ids, np.concatenate([[0], np.cumsum(full)])[starts]


def phrase_places(ids: np.ndarray, stop: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places in ids where the phrase's words stand one after another within one text (stop: its end, by place)."""
    at = np.flatnonzero(ids[:max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at[at + len(phrase) <= stop[at]]


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """Documents with each word, and all documents, over the whole table."""
    def run(batches):
        vocabulary = pa.array(words, pa.large_string())
        found, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for rows in pieces_of(batch):
                ids, starts = word_numbers(filled(rows.column("text")), vocabulary)
                owner = np.repeat(np.arange(rows.num_rows), np.diff(starts))
                at = np.flatnonzero(ids >= 0)
                pairs = np.unique(owner[at] * len(words) + ids[at])
                found += np.bincount(pairs % len(words), minlength=len(words))
                n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(words)), -1]), pa.array([*found.tolist(), n])],
                                         ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word: r.n for r in rows}
    return np.array([got.get(k, 0) for k in range(len(words))], float), got.get(-1, 0)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=None, agreement: float = 0.8, anchors: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    A template is found where words of at least `agreement` of its weight stand at their positions and its key
    phrases are complete; score is the best such share, 0 without one.  Null texts are empty: no words, no labels
    ('').  Rows with null or repeated doc_id are scanned like others; other columns are not read."""
    phrases = BASE if phrases is None else phrases
    plain = Index(templates, phrases)
    found, n = document_frequency(docs, plain.words)
    index = Index(templates, phrases, np.log((n + 1) / (found + 1)) + 1e-3, anchors)

    def run(batches):
        vocabulary = pa.array(index.words, pa.large_string())
        for batch in batches:
            for rows in pieces_of(batch):
                size = rows.num_rows
                ids, starts = word_numbers(filled(rows.column("text")), vocabulary)
                owner = np.repeat(np.arange(size), np.diff(starts))
                begin, stop = starts[:-1][owner], starts[1:][owner]
                base_labels, labels = [set() for _ in range(size)], [set() for _ in range(size)]
                n_base, score = np.zeros(size, np.int64), np.zeros(size)
                first, last = np.full(size, -1), np.full(size, -1)
                for label, phrase in index.phrases:
                    at = phrase_places(ids, stop, phrase)
                    n_base += np.bincount(owner[at], minlength=size)
                    for d, p in zip(owner[at].tolist(), (at - begin[at]).tolist()):
                        base_labels[d].add(label)
                        first[d] = p if first[d] < 0 else min(first[d], p)
                        last[d] = max(last[d], p)
                starts_of: dict[int, list[np.ndarray]] = {}
                for word, places in index.postings.items():
                    at = np.flatnonzero(ids == word)
                    for k, j in places:
                        starts_of.setdefault(k, []).append(at[at - j >= begin[at]] - j)
                for k, several in starts_of.items():
                    label, own, must = index.templates[k]
                    at = np.unique(np.concatenate(several))
                    place = at[:, None] + np.arange(len(own))
                    inside = place < stop[at][:, None] if len(at) else place < 0
                    same = (ids[np.minimum(place, max(0, len(ids) - 1))] == own) & inside if len(at) else inside
                    share = same @ index.weight[own] / index.weight[own].sum()
                    ok = (share >= agreement) & same[:, must].all(1)
                    for d, s in zip(owner[at[ok]].tolist(), share[ok].tolist()):
                        labels[d].add(label)
                        score[d] = max(score[d], min(1.0, s))
                none = first < 0
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(np.diff(starts)), pa.array(n_base),
                    pa.array(first.astype(np.int64), mask=none), pa.array(last.astype(np.int64), mask=none),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base_labels, labels)], pa.string()),
                    pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double")
