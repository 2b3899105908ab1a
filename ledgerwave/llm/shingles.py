"""Words and word shingles of whole texts as 64-bit numbers, a batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import filled

SPACE = r"[\x20\x09-\x0D]+"


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads its input over all bits, one for each seed."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end): A-Z lower-cased, cut at white space."""
    lists = pc.split_pattern_regex(pc.ascii_lower(filled(texts)), SPACE)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    empty = np.flatnonzero(names == "")
    full = index != empty[0] if len(empty) else np.ones(len(index), bool)
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return hashes[index[full]], np.concatenate([[0], np.cumsum(full)])[starts]


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words within a text, first run of every text and the end).  Texts with fewer words
    have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    size = len(words) - n + 1
    value = np.zeros(size, np.uint64)
    for k in range(n):
        value = mixed(value + words[k:k + size], k)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:size]
    inside = np.arange(size) + n <= starts[1:][owner]
    counts = np.maximum(np.diff(starts) - (n - 1), 0)
    return value[inside], np.concatenate([[0], np.cumsum(counts)])
