"""Jaccard join, passages, embeddings and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerwave.llm import jaccard
from ledgerwave.llm.common import components
from ledgerwave.llm.embeddings import near_vectors
from ledgerwave.llm.jaccard import jaccard_components, leaf_signatures, region_links, shingle_sets
from ledgerwave.llm import passages as passages_module
from ledgerwave.llm.passages import compact_windows, dense, fresh, repeated_passages, without_passages


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, k) for k in range(60, 90)] + [
        (k, k + 1) for k in range(100, 130)] + [(5, None), (7, 7), (3, 4), (4, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=3):
    w = words_of(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def variants(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 10, 11, 12, 60, 200]))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w[: len(w) - rng.choice([0, 0, 1])]))
    return out + ["", None, "  ", "one", "ONE", "one two"]


@pytest.mark.parametrize("seed, cell, rounds", [(1, 128, 2), (2, 4, 2), (3, 4, 0)])
def test_jaccard(documents, monkeypatch, seed, cell, rounds):
    real = region_links
    monkeypatch.setattr(jaccard, "region_links", lambda s, p: real(s, p, cell, rounds))
    texts = variants(seed)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = groups(range(len(sets)), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(texts)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in want}


def test_near_sets_share_a_leaf():
    rng = np.random.default_rng(5)
    for size in [*range(1, 60), 300, 1000]:
        one = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        drop = int(0.1 * len(one))
        for gone in range(drop + 1):
            two = np.sort(rng.permutation(one)[gone:])
            both = np.concatenate([one, two])
            owner, leaf = leaf_signatures(both, np.array([0, len(one), len(both)]))
            assert set(leaf[owner == 0]) & set(leaf[owner == 1]), (size, gone)


@pytest.mark.parametrize("percent", [50, 67, 75, 80, 85])
def test_near_sets_share_a_smaller_leaf(percent):
    rng = np.random.default_rng(6)
    for size in [*range(1, 60), 300, 1000]:
        one = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        for gone in {*range(min(8, len(one) * (100 - percent) // 100 + 1)), len(one) * (100 - percent) // 100}:
            two = np.sort(rng.permutation(one)[gone:])
            owner, leaf = leaf_signatures(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]),
                                          jaccard.leaf_for(percent))
            assert set(leaf[owner == 0]) & set(leaf[owner == 1]), (size, gone)


def test_jaccard_odd_ids(documents):
    text = " ".join(f"w{k}" for k in range(40))
    rows = jaccard_components(documents([text, text, text, "other words here"], ids=[None, 4, 4, None])).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows)
    assert got == [(0, 1, 0), (0, 38, 4), (4, 38, 4), (4, 38, 4)]
    assert jaccard_components(documents([])).count() == 0
    with pytest.raises(ValueError):
        jaccard_components(documents([]), percent=80)


@pytest.mark.parametrize("few, meeting", [(16, 1024), (2, 1024), (2, 4)])
def test_frequent_passages_connect_no_regions(documents, monkeypatch, few, meeting):
    """Documents that share a passage but little else are no region, and none of their sets is stored; links stay."""
    real, edges = jaccard.region_edges, []

    def seen(*args):
        edges.append(real(*args, few, meeting))
        return edges[-1]

    monkeypatch.setattr(jaccard, "region_edges", seen)
    rng = random.Random(few)
    fresh = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = fresh(40)
    texts = [fresh(k % 7 * 20) + passage + fresh(60 + k % 5 * 40) for k in range(60)] + [fresh(2500) for _ in range(2)]
    for w in texts[:10] + texts[-2:]:
        for _ in range(4):
            texts.append([x if rng.random() > 0.02 else "changed" for x in w])
    texts = [" ".join(w) for w in texts]
    sets = [shingles(t, 5) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(range(len(sets)), links)
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(texts), 5, 80, jaccard.leaf_for(80)).collect()}
    assert got == want and links
    assert components(edges[0]).count() <= 60


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_prefix_shingle_and_have_near_sketches(percent):
    rng = np.random.default_rng(7)
    for size in [*range(1, 40), 300, 1990, 2100]:
        one = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        for gone in {0, 1, size * (100 - percent) // 200, size * (100 - percent) // 100}:
            two = np.sort(np.concatenate([rng.permutation(one)[min(gone, size * (100 - percent) // 100):],
                                          rng.integers(0, 2 ** 64, gone // 3, dtype=np.uint64)]))
            both = len(np.intersect1d(one, two))
            if 100 * both < percent * (len(one) + len(two) - both):
                continue
            values, bounds = np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)])
            for often in (np.zeros(0, np.uint64), rng.permutation(one)[:size // 2]):
                owner, shingle = jaccard.prefixes(values, bounds, often, percent)
                assert set(shingle[owner == 0]) & set(shingle[owner == 1]), (size, gone)
            sets = [np.frombuffer(x, np.uint64) for x in jaccard.sketches(values, bounds)]
            a, b = jaccard.meeting_pairs(np.array([5, 6]), sets, None, percent)
            assert [*a, *b] in ([5, 6], [6, 5])


def test_short_text_is_one_shingle():
    values, bounds = shingle_sets(pa.array(["a", "a b", "A B", "", None, "b a"]), 3)
    assert np.diff(bounds).tolist() == [1, 1, 1, 0, 0, 1] and values[1] == values[2] != values[3]


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    lengths = [0, 3, 40, 5, 25, 4]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    values = rng.integers(0, 2 ** 63, bounds[-1], dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in compact_windows(values, bounds, 5))))
    want = set()
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        own = values[a:b].tolist()
        for c in range(len(own)):
            left, right = c, c
            while left and own[left - 1] > own[c]:
                left -= 1
            while right + 1 < len(own) and own[right + 1] > own[c]:
                right += 1
            if right - left + 1 >= 5:
                want.add((d, left, c, right))
    assert got == want


def test_passages(documents):
    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared, short = fresh(56), fresh(30)
    edited = list(shared)
    edited[28] = "changed"
    texts = [fresh(40) + shared + fresh(30), fresh(80) + short, shared + fresh(10), fresh(100), short + fresh(60),
             fresh(25) + edited + fresh(20), fresh(30), []]
    docs = documents([*(" ".join(t) for t in texts), None], ids=[*range(8), None])
    passages = repeated_passages(docs).collect()
    assert {(r.doc_id, r.of_doc_id) for r in passages} == {(2, 0), (5, 0)}
    exact = next(r for r in passages if r.doc_id == 2)
    assert (exact.first_word, exact.last_word, exact.of_first_word) == (0, 55, 40) and exact.similarity == 1
    near = next(r for r in passages if r.doc_id == 5)
    assert near.first_word == 25 and near.last_word == 80 and 0.8 <= near.similarity < 1
    cut = without_passages(docs, repeated_passages(docs))
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and len(left) == 9
    assert left[2].text.split() == texts[2][56:] and left[2].n_chars == len(left[2].text)
    assert left[0].text.split() == texts[0] and left[4].text.split() == texts[4] and left[None].text is None
    assert repeated_passages(documents([])).count() == 0


def lost_words(texts, passages, words=50):
    """(document, word) of the runs of `words` words that an earlier document holds as well and no passage covers."""
    runs = [{tuple(t[k:k + words]) for k in range(len(t) - words + 1)} for t in texts]
    covered = {(r.doc_id, k) for r in passages for k in range(r.first_word, r.last_word + 1)}
    return {(i, k + j) for i, t in enumerate(texts) for k in range(len(t) - words + 1) for j in range(words)
            if any(tuple(t[k:k + words]) in runs[e] for e in range(i))} - covered


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_with_frequent_phrases_and_variants(documents, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 55, 75, 140)]
    texts = []
    for p in passages:  # earlier documents hold every phrase of the passages, part-copies and variants
        texts += [fresh(60) + p[k:k + 9] + fresh(60) for k in range(0, len(p), 4)]
        texts += [fresh(30) + p[k:k + 30] + fresh(30) for k in range(0, len(p), 15)]
        for _ in range(3):
            w = list(p)
            for k in range(rng.randrange(10), len(w), 10):
                w[k] = fresh(1)[0]
            texts.append(fresh(20) + w + fresh(40))
    for p in passages * 3:
        w = list(p)
        for _ in range(rng.choice([0, 0, 1])):
            w[rng.randrange(len(w))] = "changed"
        texts.append(fresh(rng.randrange(60)) + w + fresh(rng.randrange(60)))
    found = repeated_passages(documents([" ".join(t) for t in texts])).collect()
    assert not lost_words(texts, found)
    for r in found:
        one = shingles(" ".join(texts[r.doc_id][r.first_word:r.last_word + 1]), 5)
        two = shingles(" ".join(texts[r.of_doc_id][r.of_first_word:r.of_last_word + 1]), 5)
        assert r.of_doc_id < r.doc_id and r.last_word - r.first_word >= 49
        assert len(one & two) / len(one | two) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_passage_with_an_edit_near_its_end(documents):
    shared = [f"s{k}" for k in range(50)]
    texts = [["a"] * 60 + shared + ["b"] * 60, ["c"] * 60 + [*shared[:2], "changed", *shared[3:]] + ["d"] * 60]
    found = repeated_passages(documents([" ".join(t) for t in texts]), hashes=8).collect()
    assert [(r.doc_id, r.of_doc_id) for r in found] == [(1, 0)]
    assert found[0].last_word - found[0].first_word >= 49 and found[0].similarity >= 0.8


def test_documents_that_share_less_than_a_passage_are_not_compared(documents, monkeypatch):
    """Of documents that share a phrase, or a passage that was found, no texts are fetched for every pair."""
    real, asked = passages_module.verified, []

    def seen(docs, spanned, *rest):
        asked.append(spanned.count())
        return real(docs, spanned, *rest)

    monkeypatch.setattr(passages_module, "verified", seen)
    rng = random.Random(5)
    fresh_words = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    phrase, passage = fresh_words(34), fresh_words(60)
    texts = [fresh_words(70) + phrase + fresh_words(70) for _ in range(40)]
    texts += [fresh_words(70) + passage + fresh_words(70) for _ in range(20)]
    texts += [[*texts[50][:100], "changed", *texts[50][101:]]]
    found = repeated_passages(documents([" ".join(t) for t in texts])).collect()
    assert not lost_words(texts, found)
    assert {(r.doc_id, r.of_doc_id) for r in found} >= {(k, 40) for k in range(41, 60)} | {(60, 50)}
    assert sum(asked) <= 3 * len(texts)


def test_documents_have_one_bucket(spark):
    ids = [0, 1, 2, 50, 127, 128, 10 ** 12 + 7, -1, -129, 2 ** 63 - 1, -2 ** 63]
    df = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", passages_module.placed(df["doc_id"], 51)).collect()}
    assert [got[k] for k in ids] == passages_module.placed(np.array(ids), 51).tolist()


def test_runs_that_can_be_a_new_passage():
    hits = np.zeros((5, 160), bool)
    hits[0, 50:86] = True  # too short
    hits[1, 50:110] = True  # found before
    hits[2, 50:120] = True  # reaches beyond
    hits[3, 50:110], hits[3, 70] = True, False  # not whole
    kept, longest, lone = fresh(hits, np.array([[50, 109]]), 46, 0.8)
    assert longest.tolist() == [0, 0, 70, 60, 0] and lone.tolist() == [0, 0, 0, 60, 0]
    assert kept.sum(1).tolist() == [0, 0, 70, 59, 0]
    single = np.ones(160, bool)
    assert dense(hits, single, 46, 4).tolist() == [False, True, True, True, False]
    hits[4, 0:160:2] = True
    assert not dense(hits, single, 46, 4)[4] and dense(hits, hits[4], 46, 4)[4]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [b + rng.normal(size=16) * s for b in base for s in (0.0, 0.02, 0.1, 0.15)] + [base[0] * 3, base[0]]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 15 + [None], [float("inf")] * 16, [1.0] * 3]
    table = [(k, [float(x) for x in v]) for k, v in enumerate(rows)] + [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS n")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    want = groups(range(len(rows)), [(a, b) for a, b in zip(*np.nonzero(near))])
    found = sum(got[k].n_links for k in range(len(rows)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert np.mean([got[k].component_id == want[k] for k in want]) >= 0.9
    assert all((got[1000 + k].n_links, got[1000 + k].component_id, got[1000 + k].kept) == (0, 1000 + k, True)
               for k in range(6))
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [20, 24])
def test_recall_does_not_fall_with_the_bits(spark, bits):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.902 * base + (1 - 0.902 ** 2) ** 0.5 * side])  # pairs just above the limit
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in near_vectors(df, bits=bits).collect()) >= 0.93 * 2 * len(base)


def test_equal_vectors(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in (5, 3, 9, 9)] + [(None, [1.0, 2.0, 3.0])],
                               "vec_id long, embedding array<float>")
    got = near_vectors(df).collect()
    assert [r.n_links for r in got] == [4] * 5 and {r.component_id for r in got} == {3}
    assert [r.vec_id for r in got if r.kept] == [3]


def test_embeddings_of_any_size_and_length(spark):
    """Each length is compared on its own, also a rare one; very large and very small vectors keep their directions."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 3))
    rows = [(k, list(map(float, v * s))) for k, (v, s) in enumerate(
        (v, s) for v in base for s in (1.0, 1e200, 1e-200, 3.0))]
    rows += [(100, [1.0, 2.0, 3.0, 4.0]), (101, [1e200, 2e200, 3e200, 4e200]), (102, [-1.0, 0.0, 0.0, 0.0]), (103, [5.0]),
             (104, [7.0]), (105, [0.0, 0.0, 0.0]), (106, []), (107, [5e-324, 0.0, 0.0]), (108, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and any(v)}
    edges = [(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= 0.9 * np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])]
    component = groups([i for i, _ in rows], edges)
    assert got == {i: (sum(a == i for a, _ in edges), component[i]) for i, _ in rows}
