"""Best-fit packing by sums of squares.

A document's ids are cut into pieces of `size` from its end, so only its first piece can be shorter; full pieces are
sequences of their own.  A shorter piece goes where the sum over gaps of (open bins with that gap) squared becomes
smallest, a new bin included.  Every task packs what it holds while reading it, longest pieces first, and keeps only
its open bins.  Documents are dealt out evenly, many to a task, so that the bins that tasks leave open are few."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import pieces_of
from .tokens import encode_texts

#: Documents a packing task takes.
DOCS_PER_TASK = 50_000

PIECE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


class SquaredGaps:
    """Open bins by gap.  place(length) returns (bin, offset); bins are numbered in order of opening."""

    def __init__(self, size: int):
        self.size, self.bins = size, [[] for _ in range(size)]
        self.n = np.zeros(size + 1, np.int64)  # open bins with each gap; a full bin is closed
        self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        size, n = self.size, self.n
        if length == size:
            return self.alone()
        # From gap g to gap g - length: the sum changes by 2 (n[g - length] - n[g] + 1), by 1 - 2 n[g] if it closes.
        change = 2 * (n[:size - length] - n[length:size]) + 2
        change[0] = 1 - 2 * n[length]
        change[n[length:size] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        fresh = 2 * n[size - length] + 1
        if change[best] <= fresh:
            gap = best + length
            at = self.bins[gap].pop()
            n[gap] -= 1
        else:
            gap, at = size, self.opened
            self.opened += 1
        if gap > length:
            self.bins[gap - length].append(at)
            n[gap - length] += 1
        return at, size - gap

    def alone(self) -> tuple[int, int]:
        """A bin for one full piece."""
        self.opened += 1
        return self.opened - 1, 0


def cut_documents(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, n (ids with the end id) and its pieces: number, start, length and crc32 of the ids."""

    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch):
                bounds, ids = encode_texts(rows.column("text"), path)
                cells, end = [], np.array([end_id], "<u4")
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.concatenate([ids[a:b], end])
                    short = len(own) % size or size
                    at = [0, *range(short, len(own) + 1, size)]
                    cells.append([{"piece": k, "start": s, "length": e - s,
                                   "ids_crc32": zlib.crc32(own[s:e].tobytes())}
                                  for k, (s, e) in enumerate(zip(at[:-1], at[1:]))])
                kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                           ("ids_crc32", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(bounds) + 1), pa.array(cells, kind)],
                    ["doc_id", "n", "pieces"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n long, pieces {PIECE}")


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024,
         docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    Null and empty texts are a document of the end id alone.  Rows with equal or null doc_id are documents of their
    own.  Ties in the sum go to the smallest gap, before a new bin.  Other columns are not read.  An empty table
    packs into nothing."""
    parts = max(1, -(-docs.count() // docs_per_task))
    spread = (cut_documents(docs, path, end_id, size).repartition(parts)
              .sortWithinPartitions(F.desc(F.col("pieces")[0]["length"]), "doc_id", "n", F.col("pieces")[0]["ids_crc32"]))

    def run(batches):
        gaps, base = SquaredGaps(size), TaskContext.get().partitionId() << 40
        for batch in batches:
            pieces = batch.column("pieces")
            of = np.repeat(np.arange(batch.num_rows), np.diff(pieces.offsets.to_numpy()))
            flat = pieces.flatten()
            number, length = (flat.field(k).to_numpy() for k in ("piece", "length"))
            bins, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for k, (p, n) in enumerate(zip(number.tolist(), length.tolist())):
                bins[k], offset[k] = gaps.place(n) if p == 0 else gaps.alone()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *(flat.field(k) for k in (
                    "piece", "start", "length", "ids_crc32")), pa.array(base + bins), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return spread.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")
