"""Vector codes, page texts and collocations against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerwave.llm import vector_codes as vc
from ledgerwave.llm.collocations import collocations
from ledgerwave.llm.double_array import Trie
from ledgerwave.llm.page_blocks import blocks
from ledgerwave.llm.page_text import features, grow, judge, labelled, page_texts

INF, NAN = float("inf"), float("nan")


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """vec_id, code, error, label, sha of vectors of one length, all entries compared in every round."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[q[p * w:(p + 1) * w] for p in range(parts)] for _, _, q in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(c[p], books[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found[p]) if f == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in n) for n in last]
    totals = {}
    for (_, lab, _), e in zip(kept, errors):
        totals[lab] = totals.get(lab, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), e, totals[lab], sha)
                   for (i, lab, _), n, e in zip(kept, last, errors)), key=str)


def vectors(spark, rows, label="int"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 f"vec_id long, embedding array<double>, label {label}, q string, sums int")


def codes(df, **options):
    return sorted(map(tuple, vc.vector_codes(df, **options).collect()), key=str)


def test_codes_against_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=8) * 0.02, 2)], int(rng.integers(0, 3)))
            for i in rng.permutation(300)]
    rows += [(500, rows[0][1], None), (501, rows[0][1], None), (None, rows[1][1], 1), (7, rows[2][1], 2),
             (502, None, 1), (503, [1.0] * 7 + [None], 1), (504, [1.0] * 7 + [NAN], 1), (505, [1.0] * 7 + [-INF], 1)]
    assert codes(vectors(spark, rows).repartition(5)) == plain_codes(rows)
    assert codes(vectors(spark, rows), entries=12, rounds=7) == plain_codes(rows, entries=12, rounds=7)


def test_codes_of_few_and_wide_vectors(spark):
    rows = [(3, [-1e-3, 0.5, 2e5, -3e5, 0.0, 1.0, 2.0, 3.0], 1), (1, [4e5, 0.0, 0.0, 1e5, 7.0, 7.0, 7.0, 7.5], 1),
            (2, [4e5, 0.0, 0.0, 1e5, 7.0, 7.0, 7.0, 7.4], None)]
    assert codes(vectors(spark, rows), entries=2) == plain_codes(rows, entries=2)
    assert codes(vectors(spark, [])) == []
    assert codes(vectors(spark, [(1, None, 2)])) == []


def test_codes_of_odd_lengths(spark):
    """Every length is a table of its own; huge components are held, not an overflow."""
    one = [(k, [0.1 * k, 0.2, 0.3, 0.4 * k], 1) for k in range(5)]
    two = [(k, [0.5 * k] * 8, 2) for k in range(10, 14)]
    got = codes(vectors(spark, one + two))
    assert got == sorted(plain_codes(one) + plain_codes(two), key=str)
    odd = codes(vectors(spark, [(1, [], 0), (2, [1.0, 2.0, 3.0], 0), (3, [1e308, -1e308, 1e200, 0.0], 0)]))
    assert [(i, c, e) for i, c, e, *_ in odd] == [(1, "00000000", 0), (2, "00000000", 0), (3, "01010100", 0)]


def test_assign_looks_at_moved_entries_only(monkeypatch):
    rng = np.random.default_rng(0)
    book = rng.integers(-5, 5, (20, 3))
    x = rng.integers(-5, 5, (200, 3))
    entry, dist = np.full(200, -1), np.zeros(200, np.int64)
    vc.assign(x, book, np.ones(20, bool), entry, dist)
    moved = np.zeros(20, bool)
    moved[[2, 9]] = True
    after = book.copy()
    after[[2, 9]] = rng.integers(-5, 5, (2, 3))
    seen = []
    full = vc.distances
    monkeypatch.setattr(vc, "distances", lambda a, b: seen.append((len(a), len(b))) or full(a, b))
    before = entry.copy()
    vc.assign(x, after, moved, entry, dist)
    want = ((x[:, None] - after) ** 2).sum(2)
    assert (entry == want.argmin(1)).all() and (dist == want.min(1)).all()
    held = int(np.isin(before, [2, 9]).sum())
    assert sorted(seen) == sorted([(held, 20), (200 - held, 2)])


def test_distances_stay_exact_beyond_floats():
    x, book = np.array([[2 ** 28 + 1, 1]]), np.array([[0, 0], [2 ** 28, 3]])
    assert vc.distances(x, book).tolist() == [[(2 ** 28 + 1) ** 2 + 1, 1 + 4]]




# --- page texts

def texts(spark, pages):
    rows = [(k, f"u{k}", h, "clash", 3) for k, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(page_texts(df).collect())
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    return [r.text for r in got]


LEDE = "The council met on Tuesday to discuss the bridge, which has been closed since the storm in March, and its cost."
MORE = "Engineers said that the repair would take at least two years and that traffic had to go by the old road until then."
PAGES = {
    "named places": (
        f"""<!doctype html><html><head><title>Bridge</title><script>if (a < b) document.write("</p><p>no")</script>
        <style>p > a {{}}</style></head><body class="has-sidebar"><header><a href="/">Daily</a> <span>News of the town</span></header>
        <nav><ul><li><a href="/a">Home</a><li><a href="/b">Sport</a></ul></nav>
        <div id="cookie-notice">We use cookies to make this site work and to learn how it is read. <button>Accept all</button></div>
        <main><article><header><h1>Bridge   stays\n closed</h1></header><p>{LEDE}<p>No.</p><p>Short &amp; <b>bo</b>ld&nbsp;&#x21;<br>next</p>
        <aside><p>{MORE}</p></aside><div class="ad">Buy a car today, it is the best that you will ever drive to work.</div>
        <ul><li>One</li><li><a href="x">Two</a></li></ul><p>{MORE}</p><div class="share-buttons"><a href="t">Tell a friend</a></div></article>
        <section id="comments"><article class="comment"><p>{LEDE} I do not believe it.</p></article></section></main>
        <form><label>Your name</label><input name="q"><textarea>{LEDE}</textarea></form>
        <footer>&copy; 2024 Daily, all rights reserved by the owners of the paper.</footer></body></html>""",
        f"Bridge stays closed\n{LEDE}\nNo.\nShort & bold ! next\nOne\nTwo\n{MORE}"),
    "classes of old pages": (
        f"""<body><div class="top-bar header"><a href="/">Paper</a></div><div class="navMenu nav"><a href="1">A</a> <a href="2">B</a></div>
        <div id="page-content" class="content"><h2>Head</h2><div>{LEDE}</div><div>{MORE}</div>
        <div class="related"><a href="3">Other stories of the week</a></div></div>
        <div class="sidebar"><p>{MORE}</p></div><div class="reader-comments">{LEDE}</div></body>""",
        f"Head\n{LEDE}\n{MORE}"),
    "no names": (
        f"""<table><tr><td><a href="1">Home</a><td><a href="2">News</a><td><a href="3">Contact us</a></table>
        <h1>The bridge stays closed</h1><p>{LEDE}</p><p>{MORE}</p><p>{LEDE} {MORE}</p><p><a href="1">Back</a> | <a href="2">Top</a></p>""",
        f"The bridge stays closed\n{LEDE}\n{MORE}\n{LEDE} {MORE}"),
    "only links": ("<ul>" + "<li><a href=1>Read on about it</a>" * 9 + "</ul>", ""),
    "comments and broken tags": (
        f"<article><!-- <p>no --><p>1 < 2 and a<b>b</b> {LEDE}<p title='a > b' x=\"y>\">{MORE}</p></article><!-- open <p>{LEDE}",
        f"1 < 2 and ab {LEDE}\n{MORE}"),
    "cut off": (f"<article><h1>Head</h1><p>{LEDE}</p><p>{MORE} <a hre", f"Head\n{LEDE}\n{MORE}"),
}


@pytest.fixture(scope="module")
def pages_out(spark):
    return dict(zip(PAGES, texts(spark, [h for h, _ in PAGES.values()])))


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name, pages_out):
    assert pages_out[name] == PAGES[name][1]


def test_odd_pages(spark):
    long = "<article>" + f"<p>{LEDE}</p>" * 20_000 + "</article>"
    deep = "<div>" * 50_000 + "<p>" + LEDE
    junk = "<" * 50_000 + "<a title='" * 20_000 + "<!--" + "</" * 20_000
    out = texts(spark, [None, "", " ", "<article><p>&#0;&zzz; &lt;p&gt;</p></article>", long, deep, junk, "<article>é\u2003x</article>"])
    assert out[:4] == ["", "", "", "\ufffd&zzz; <p>"]
    assert out[4] == "\n".join([LEDE] * 20_000) and out[5] == LEDE and out[7] == "é x"
    assert texts(spark, []) == []
    rows = [(None, None, f"<article>{LEDE}</article>"), (1, "u", f"<article>{LEDE}</article>"), (1, "u", None)]
    got = page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(LEDE)), (1, 0), (1, len(LEDE))]


def test_blocks_know_words_links_and_places():
    rows = blocks("<nav><a href=x>one two</a> three</nav><article><h2>head</h2><p>a <a>b c</a><div>d</div></article>e")
    assert rows == [("one two three", 3, 2, 0, 1, 0), ("head", 1, 0, 2, 0, 1), ("a b c", 3, 2, 2, 0, 0), ("d", 1, 0, 2, 0, 0),
                    ("e", 1, 0, 0, 0, 0)]


def test_tree_fits_its_table_and_random_ones():
    x, y = labelled()
    assert (judge(grow(x, y), x) == (y > 0)).mean() == 1.0
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 2] < 3) | (x[:, 3] == 5)).astype(int)
    assert (judge(grow(x, y), x) == (y > 0)).all()
    assert features(np.zeros((0, 5), int)).shape == (0, 10)


# --- collocations

def plain_collocations(rows, least, first=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for at in range(len(w) - k + 1):
                    count[lang, tuple(w[at:at + k])] += 1
    seen = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in seen.items():
        longer = [b for (g, q), b in seen.items() if g == lang and len(q) > len(p) and any(
            q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), a, count[lang, p[:k]], count[lang, p[k:]], total[lang]))
    out.sort()
    ranked, rank = [], Counter()
    for lang, score, _, p, a, left, right, n in out:
        rank[lang] += 1
        if rank[lang] <= first:
            ranked.append((lang, rank[lang], p.decode(), a, left, right, n, -score))
    return ranked


def found(spark, rows, **options):
    df = spark.createDataFrame([(k, t, g, "x", 1) for k, (g, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, word string, a int")
    return [tuple(r) for r in sorted(collocations(df.repartition(3), **options).collect(), key=lambda r: (r.lang, r.rank))]


def chatter(seed, texts=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "Ñandú", "The", "the", "x" * 80, "x" * 81, "\x01", "a\x01", "本"]
    out = []
    for _ in range(texts):
        words = []
        for _ in range(rng.choice([0, 1, 3, 40])):
            words += rng.choice([["new", "York", "times"], ["new", "york"], ["of", "the"], ["a", "a", "a", "a", "a"],
                                 [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(
            w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " - "]) for w in words)))
    return out + [("en", None), ("fr", ""), (None, " ,. ;"), ("de", "only these words here"), ("en", "new york " * 400)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_against_counting(spark, seed):
    rows = chatter(seed)
    want = plain_collocations(rows, 5)
    assert len(want) > 20 and {len(r[2].split(" ")) for r in want} == {2, 3, 4}
    assert found(spark, rows, least=5) == want
    # Many blocks of the vocabulary and many tries, and a short list.
    assert found(spark, rows, least=5, first=4, block_words=7, block_phrases=9) == plain_collocations(rows, 5, 4)


def test_collocations_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, "one two")]) == []
    assert found(spark, [("en", "alone, " * 50)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_trie_counts_phrases(seed):
    rng = np.random.default_rng(seed)
    width, top = 4, int(rng.choice([3, 30, 2000]))
    phrases = {tuple(rng.integers(1, top + 1, rng.integers(1, width + 1))) for _ in range(3000)}
    grid = np.array([p + (0,) * (width - len(p)) for p in phrases])
    ids = rng.integers(0, top + 1, 5000)
    trie = Trie(grid)
    total = np.zeros(len(grid), np.int64)
    for at, state in trie.levels(ids, width):
        number = trie.phrase[state]
        total += np.bincount(number[number >= 0], minlength=len(grid))
    text = Counter(tuple(ids[k:k + n]) for n in range(1, width + 1) for k in range(len(ids) - n + 1))
    assert total.tolist() == [text[tuple(p[p > 0])] for p in grid]
    assert len(trie.base) < 4 * grid.size + 2 * top
