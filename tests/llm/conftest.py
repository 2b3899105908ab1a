import pytest

pytest.importorskip("public_tokenizers")

LONG = "the quick brown fox jumps over it's 12 lazy dogs, again and again.\n" * 900


@pytest.fixture
def documents(spark):
    """A table of documents from texts; doc_ids count from 0 unless given.  Has a clashing extra column."""
    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or [None] * len(texts)
        rows = [(i, t, g, "src", None if t is None else len(t), 7) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, score int")

    return make


@pytest.fixture
def edge_texts():
    return ["", None, " ", "one", "don't stop", "a  b\n\n c ", "é è <|endoftext|> x", LONG, "x" * 50_000, "one",
            "tail space ", "\n", "ÀÉ ß İ 1234 $%&"]
