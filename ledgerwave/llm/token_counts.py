"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of frequent pieces and their numbers of tokens, at most `entries` of them, fitted on a
bounded sample of rows; it only saves work, any table gives the same counts.  Tier two is each worker's own memo,
which encodes what tier one misses.  No piece is shuffled."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import filled, pieces_of, worker_cache
from .tokens import MEMO_ENTRIES, cut, encoder


def frequent_pieces(docs: DataFrame, path: str, rows: int = 1000, longest: int = 20_000,
                    entries: int = 32_768) -> dict[str, int]:
    """The most frequent pieces of `rows` texts of at most `longest` characters, with their numbers of tokens."""
    sample = [r.text for r in docs.where(F.length("text") <= longest).select("text").limit(rows).collect()]
    seen: Counter = Counter()
    for text in sample:
        head, *rest = text.split(" ")
        seen.update(" " + p for p in rest)
    enc = encoder(path)
    return {p: len(enc.encode(p)) // 4 for p, n in islice(seen.most_common(entries), entries) if n > 1}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, frequent: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have no tokens; rows with a null or repeated doc_id are counted like others; other columns
    are not read.  `frequent` is tier one (default: fitted on a sample)."""
    frequent = frequent_pieces(docs, path) if frequent is None else frequent
    names = list(frequent)
    counts = np.fromiter(frequent.values(), np.uint32, len(frequent)).tobytes()
    sent = docs.sparkSession.sparkContext.broadcast((names, counts))
    label = f"frequent {zlib.crc32(repr(names).encode())} {path}"

    def run(batches):
        def first_tier():
            keys, n = sent.value
            return dict(zip(keys, np.frombuffer(n, np.uint32).tolist()))

        tier_one = worker_cache(label, first_tier)
        enc = encoder(path)
        tier_two = worker_cache(f"misses {path}", dict)

        def miss(piece):
            n = tier_two.get(piece)
            if n is None:
                n = len(enc.fresh(piece)) // 4
                if len(tier_two) < 2 * MEMO_ENTRIES:
                    tier_two[piece] = n
            return n

        for batch in batches:
            for rows in pieces_of(batch):
                texts = filled(rows.column("text"))
                odd, pieces, index, starts = cut(texts)
                n = np.fromiter((tier_one.get(p) or miss(p) for p in pieces), np.int64, len(pieces))
                total = np.add.reduceat(n[index], starts[:-1]) if len(index) else np.zeros(0, np.int64)
                for k in np.flatnonzero(odd):
                    total[k] = len(enc.whole(texts[int(k)].as_py())) // 4
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(total),
                     pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
