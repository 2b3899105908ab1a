"""Ids of whole texts from tokenizer files, batch by batch.

A text is cut at spaces into pieces that the tokenizer treats independently.  Equal pieces of a batch are encoded
once, with a memo that lives as long as the worker; the ids of the texts are then gathered by index."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import filled, worker_cache

#: Entries of a worker's memo.  Pieces beyond it are encoded each time; the ids are the same.
MEMO_ENTRIES = 250_000
#: A space before another white space or at the end: such texts are encoded whole.
_IRREGULAR = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"
#: Letters that lower-casing and composition leave one character, then punctuation that starts no contraction.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PRINTED = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
#: Places in a text where a token ends whatever follows, for tokenizers that drop white space.
_TOKEN_ENDS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: Characters that stand for bytes: printed ones for themselves, the others, in order, from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PLAIN} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class PieceEncoder:
    """Ids of pieces by a `tokenizers` file: without added special tokens; special strings in a text are special.

    Letters, alone or before punctuation, go straight to the file's BPE model, which is what its pre-tokeniser would
    hand over; any other piece goes through the whole tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.drops_space = self.tokenizer.normalizer is not None
        #: Texts that are not prepared: a mark may compose with the letter before it, in one case only, and special
        #: strings are looked for before lower-casing.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_they_are = r"\p{M}" + (f"|(?i:{'|'.join(added)})" if added else "")
        self.memo: dict[str, bytes] = {}
        self.entries = 2 * MEMO_ENTRIES if self.drops_space else MEMO_ENTRIES  # prepared pieces are short
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            spelt = text.encode().decode("latin-1").translate(_BYTE)
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(self.parts) < MEMO_ENTRIES // 2:
                self.parts[text] = ids
        return ids

    def fresh(self, piece: str) -> bytes:
        if self.drops_space and piece.isascii() and piece.isalpha():  # most pieces; the memo holds them already
            return array("I", [t.id for t in self.model.tokenize(piece.lower())]).tobytes()
        if not self.drops_space and (m := _WORD.fullmatch(piece)):
            return self.part(m[1]) + self.part(m[2]) if m[2] else self.part(m[1])
        if not _PRINTED.fullmatch(piece):
            return self.whole(piece)
        ids = b""
        if self.drops_space:
            for word in piece.split():
                m = _WORD.fullmatch(word.lower())
                ids += (self.part(m[1]) + self.part(m[2]) if m[2] else self.part(m[1])) if m else self.whole(word)
            return ids
        for k, line in enumerate(piece.split("\n")):
            m = _WORD.fullmatch(line)
            if not m or k and m[1][0] == " ":
                return self.whole(piece)
            ids += (self.part("\n") if k else b"") + self.part(m[1]) + (self.part(m[2]) if m[2] else b"")
        return ids

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Texts of equal ids that hold fewer different pieces, for tokenizers that lower-case and drop white space:
        A-Z are lower-cased, lines and punctuation behind a letter stand after a space."""
        lines = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        apart = pc.replace_substring_regex(lines, _TOKEN_ENDS, r"\1 \2")
        return pc.if_else(pc.match_substring_regex(texts, self.as_they_are), texts, apart)

    def encode(self, piece: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        found = self.memo.get(piece)
        if found is None:
            found = self.fresh(piece)
            if len(self.memo) < self.entries:
                self.memo[piece] = found
        return found


def encoder(path: str) -> PieceEncoder:
    return worker_cache(f"pieces {path}", lambda: PieceEncoder(path))


def cut(texts: pa.Array):
    """(irregular mask, dictionary of pieces, piece index of every place, first place of every text and the end).

    Texts of the mask have one empty piece.  Every piece but a text's first stands for itself after a space; first
    pieces are entries of their own at the dictionary's end."""
    odd = pc.match_substring_regex(texts, _IRREGULAR)
    lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = index[starts[:-1]]
    later = np.ones(len(index), bool)
    later[starts[:-1]] = False
    used = np.bincount(index[later], minlength=len(names)) > 0
    lead, where = np.unique(first, return_inverse=True)
    at = np.cumsum(used) - 1
    index = np.where(later, at[index], 0)
    index[starts[:-1]] = int(used.sum()) + where
    pieces = [" " + n for n, u in zip(names, used.tolist()) if u] + [names[k] for k in lead.tolist()]
    return odd.to_numpy(zero_copy_only=False), pieces, index, starts


def cut_prepared(texts: pa.Array, prepared):
    """As `cut`, for tokenizers that drop white space: a piece has the same ids wherever it stands."""
    odd = pc.match_substring_regex(texts, _IRREGULAR)
    lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), prepared(texts)), " ")
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return odd.to_numpy(zero_copy_only=False), pieces, coded.indices.to_numpy(), starts


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first id of every text and the end, all ids)."""
    enc = encoder(path)
    texts = filled(texts)
    odd, pieces, index, starts = cut_prepared(texts, enc.prepared) if enc.drops_space else cut(texts)
    coded = [enc.encode(p) for p in pieces]
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    begin = np.cumsum(size) - size
    ids = np.frombuffer(b"".join(coded), "<u4")
    n = size[index]
    ends = np.cumsum(n)
    take = np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    bounds = np.concatenate([[0], ends])[starts]
    out = ids[take]
    if odd.any():
        cuts = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k in np.flatnonzero(odd):
            cuts[k] = np.frombuffer(enc.whole(texts[int(k)].as_py()), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
        out = np.concatenate(cuts)
    return bounds, out
