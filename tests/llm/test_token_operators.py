"""Token operators against the tokenizer libraries, text by text."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerwave.llm import token_files, tokens
from ledgerwave.llm.chunked_bpe import decode_ids, encode_ids
from ledgerwave.llm.packing import SquaredGaps, pack
from ledgerwave.llm.token_counts import token_counts
from ledgerwave.llm.token_files import TokenFile, file_bytes, read_ids, write_ids
from ledgerwave.llm.tokens import encode_texts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path, edge_texts):
    own = Tokenizer.from_file(path)
    texts = [*edge_texts, "<|startoftext|>Hi<|ENDOFTEXT|>", "end. \n", "a\x1cb \x1cc", "  x", "I'll we've 'tis"]
    bounds, ids = encode_texts(pa.array(texts, pa.string()).slice(0), path)
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids, t
    part = pa.array(texts, pa.string()).slice(2, 4)
    bounds, ids = encode_texts(part, path)
    assert ids[:bounds[1]].tolist() == own.encode(texts[2], add_special_tokens=False).ids


def test_prepared_texts_have_fewer_pieces_and_the_same_ids():
    texts = ["Word, word.\nWord;word,### The word's", "H\u0331, I\u0307.", "it'S, 'RE-do.'s", "<|STARTOFTEXT|>a<|endoftext|>,",
             "é,É.\n\nx", ""]
    own = Tokenizer.from_file(WORD)
    bounds, ids = encode_texts(pa.array(texts), WORD)
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids, t
    text = pa.array(["Word, word.\nWord;" * 50], pa.large_string())
    pieces = tokens.cut_prepared(text, tokens.encoder(WORD).prepared)[1]
    assert set(pieces) == {"word", ",", ".", ";word", ";"}


@pytest.mark.parametrize("values", [[], [5], list(range(700)), [3] * 511 + [2 ** 32 - 1], [0, 2 ** 32 - 1] * 400,
                                    np.random.default_rng(0).integers(0, 50_000, 5000).tolist()])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    cut = len(ids) // 3
    file = TokenFile(file_bytes([4, None], np.array([cut, len(ids) - cut]), ids, 0.9))
    assert file.doc_ids == [4, None]
    assert file.ids(0).tolist() == ids[:cut].tolist() and file.ids(1).tolist() == ids[cut:].tolist()
    assert file.span(len(ids) // 2, len(ids)).tolist() == ids[len(ids) // 2:].tolist()


def test_exceptions_are_stored_apart():
    ids = np.r_[np.zeros(500), np.full(12, 2 ** 20)].astype(np.uint32)
    assert len(token_files.encode_blocks(ids, 0.9)[0]) < 12 + 12 * 6 + 8
    with pytest.raises(ValueError):
        TokenFile(b"x" * 64)


def test_token_files(spark, documents, edge_texts):
    ids = [*range(20, 20 + len(edge_texts) - 1), None]
    manifest = write_ids(documents(edge_texts, ids), WORD, end_id=1, file_ids=3000)
    assert manifest.count() > 1
    got = sorted(read_ids(spark, manifest).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    own, start = Tokenizer.from_file(WORD), 0
    for r, (i, t) in zip(got, sorted(zip(ids, edge_texts), key=lambda x: (x[0] is not None, x[0]))):
        want = own.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)
    assert len(got) == len(ids)


def test_empty_tables(spark, documents):
    none = documents([])
    assert read_ids(spark, write_ids(none, WORD)).count() == 0
    assert pack(none, BYTE).count() == token_counts(none, BYTE).count() == 0
    assert decode_ids(encode_ids(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("frequent", [None, {}, {" the": 1, "x": 1}])
def test_counts(documents, edge_texts, byte_tokenizer, frequent):
    got = token_counts(documents(edge_texts), BYTE, limit=100, frequent=frequent).orderBy("doc_id").collect()
    for r, t in zip(got, edge_texts, strict=True):
        n = len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len((t or "").encode()), n, n > 100)


def test_counts_of_repeated_pieces_with_nul(documents, byte_tokenizer):
    texts = ["one h\0e\0l\0l\0o two antidisestablishmentarianism three"] * 3 + ["x \0 \0 y incomprehensibilities"] * 2
    got = token_counts(documents(texts), BYTE).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(byte_tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunked_encoding(documents, edge_texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*edge_texts, "ab " * 300 + "z" * 900 + " cd\n\n  e'll" * 200, "\n" * 3000 + "x", edge_texts[7]]
    ids = [*range(len(texts) - 1), 7]  # the long text twice under one id
    coded = encode_ids(documents(texts, ids), RANKS, P.PATTERN, chunk=200, overlap=50)
    got = sorted(map(tuple, decode_ids(coded, RANKS, P.PATTERN).drop("decoded").collect()))
    want = []
    for i, t in zip(ids, texts):
        own = library.encode_ordinary(t or "")
        want.append((i, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_packing(documents, edge_texts, byte_tokenizer):
    texts = edge_texts * 3
    rows = pack(documents(texts), BYTE, end_id=2, size=64).collect()
    ids = {k: byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
    bins, seen = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(seen.values()) // 64) + 2


def test_squared_gaps_takes_the_least_sum():
    rng, gaps, held = np.random.default_rng(3), SquaredGaps(20), {}
    for length in rng.integers(1, 21, 400).tolist():
        before = {b: 20 - n for b, n in held.items() if n < 20}

        def cost(change):
            counts = {}
            for g in {**before, **change}.values():
                counts[g] = counts.get(g, 0) + (g > 0)
            return sum(n * n for g, n in counts.items() if g)

        least = min([cost({b: g - length}) for b, g in before.items() if g >= length] + [cost({"new": 20 - length})])
        at, offset = gaps.place(length)
        assert offset == held.get(at, 0)
        assert cost({at if at in before else "new": 20 - offset - length}) == least
        held[at] = offset + length
