"""Quality rules, language ID and licence scans."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerwave.llm.languages import fit, learn, predict
from ledgerwave.llm.licences import scan
from ledgerwave.llm.quality import Rule, apply_rules, cascade_order, default_rules, measured, passing

PROSE = "Every morning the small harbour wakes with gulls and engines while nets are mended by patient hands. "


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    again = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(again))


def test_measures(documents, edge_texts):
    texts = [*edge_texts[:7], *edge_texts[9:], PROSE * 3, "a b c d e f g h " * 5, "x\ny\nx\n \n \nx", "é ## é"]
    got = measured(documents(texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_verdicts_and_rows(documents):
    texts = [PROSE + "Later tides bring other boats, other voices, and quiet evening lamps along stone walls.", PROSE * 9,
             None, "", "## ** && $$ %% " * 10, ("SHOUTING " * 3 + "\n").join(map(chr, range(97, 120))), "few words"]
    docs = documents(texts)
    rows = {r.doc_id: r for r in apply_rules(docs).collect()}
    assert len(rows) == len(texts)
    assert [rows[k].kept for k in range(7)] == [True, False, False, False, False, False, False]
    kept = passing(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert passing(documents([])).count() == 0


def test_order_never_changes_the_verdict(documents):
    docs = documents([PROSE, "# " * 40, "A B C D " * 20])
    rules = [Rule("never", F.lit(False)), Rule("null", F.lit(None).cast("boolean")),
             Rule("symbols", F.col("n_symbols") > 10)]
    assert cascade_order(measured(docs), rules)[0].name == "symbols"
    a = {r.doc_id: r.kept for r in apply_rules(docs, rules).collect()}
    b = {r.doc_id: r.kept for r in apply_rules(docs, rules[::-1]).collect()}
    assert a == b and len(default_rules()) == 5


GERMAN = "der die und nicht mit einer ist das auf für von den wird sich auch"
ENGLISH = "the and of with that this from they have been which would their there about"


def mixed_corpus():
    texts, langs = [], []
    for k in range(120):
        own = (GERMAN if k % 2 else ENGLISH).split()
        texts.append(" ".join(own[(k * j + j) % len(own)] for j in range(1, 14)))
        langs.append("de" if k % 2 else "en")
    return texts, langs


def test_languages(documents):
    texts, langs = mixed_corpus()
    docs = documents([*texts, None, "", "123 !!"], langs=[*langs, "en", None, "de"])
    got = predict(docs, learn(docs, per_language=30)).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 3 and "source" in got[0].asDict()
    held = [(r.lang_pred, g) for r, g in zip(got, langs) if r.held_out]
    assert len(held) > 10 and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert [(r.lang_pred, r.score) for r in got[-3:]] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_without_rows(documents):
    assert fit([]) is None and learn(documents([])) is None
    assert [r.lang_pred for r in predict(documents(["words"]), None).collect()] == ["und"]
    assert predict(documents([]), None).count() == 0


def test_languages_learn_from_the_fold_only(documents):
    import zlib

    from ledgerwave.llm.languages import training_rows

    texts, langs = mixed_corpus()
    rows = training_rows(documents(texts, langs=langs), 1000, 1000)
    want = sorted(t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 4 != 2)
    assert sorted(t for t, _ in rows) == want


@pytest.mark.parametrize("text, base, labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0.", "", "apache-2.0"),
    ("x all rights\nreserved; All Rights Reserved", "reserved", "reserved"),
    ("the apache helicopter had a license", "", ""), ("cc  by", "cc-by", "cc-by"), (None, "", ""), ("", "", "")])
def test_licences(documents, text, base, labels):
    filler = ["the river and the hill version of words under a tree"] * 20
    got = {r.doc_id: r for r in scan(documents([text, *filler])).collect()}
    assert (got[0].base_labels, got[0].labels) == (base, labels)
    assert len(got) == 21 and all(r.labels == "" for k, r in got.items() if k)


def test_licence_places(documents):
    r = scan(documents(["a CC-BY b all rights reserved cc by", "q"], ids=[5, None])).where("doc_id = 5").first()
    assert tuple(r)[:5] == (5, 9, 3, 1, 7)
    assert scan(documents([])).count() == 0
