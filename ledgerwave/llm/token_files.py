"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents: their ids one after another, cut into blocks of `BLOCK` ids.  A block keeps its
minimum, the bit width that a chosen percentile of the differences needs, the differences packed at this width, and
the positions and values of those that do not fit.  The file's index has the place where each block starts, so a
document or a range is read without the rest.

Layout (little-endian): magic, 4 counts (documents, ids, blocks, bytes of blocks); then per document its id, 1 if
the id is null, its number of ids; then the start of each block and the end; then the blocks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pieces_of, shared_folder, stored, tasks
from .tokens import encode_texts

MAGIC = b"LWPFOR01"
BLOCK = 512
#: Texts are encoded in runs of about this many bytes: longer ones hold fewer different pieces a byte.
ENCODE_BYTES = 6_000_000
#: A file ends with the document that brings it to this many ids.
FILE_IDS = 2_000_000
LANES = 64


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values under 2 ** width, a multiple of 64 in each, as rows of packed 64-bit words."""
    rows = values.reshape(-1, LANES).astype(np.uint64)
    out = np.zeros((len(rows), width), np.uint64)
    for k in range(LANES if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack_bits, for rows of BLOCK values."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint64)
    rows, mask = words.reshape(-1, width), np.uint64((1 << width) - 1)
    out = np.empty((len(rows), LANES), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * width, 64)
        out[:, k] = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, k] |= rows[:, word + 1] << np.uint64(64 - shift)
    return (out & mask).reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """One byte string per block.  The last block is filled up with its own last id."""
    if not len(ids):
        return []
    grid = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1])]).astype(np.uint32).reshape(-1, BLOCK)
    base = grid.min(1)
    diff = grid - base[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _width(np.partition(diff, rank, axis=1)[:, rank])
    over = diff >> width[:, None].astype(np.uint32) if width.max() < 32 else (
        diff.astype(np.uint64) >> width[:, None].astype(np.uint64))
    out: list[bytes] = [b""] * len(grid)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = pack_bits(diff[at] & np.uint32((1 << w) - 1), w)
        for k, row in zip(at.tolist(), words):
            far = np.flatnonzero(over[k])
            head = np.array([base[k], w, len(far)], "<u4").tobytes()
            out[k] = head + row.tobytes() + far.astype("<u2").tobytes() + diff[k, far].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """All values of the blocks, the filling of a file's last block included."""
    out = np.empty((len(blocks), BLOCK), np.uint32)
    heads = [np.frombuffer(b[:12], "<u4").tolist() for b in blocks]
    widths = np.array([h[1] for h in heads])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        size = BLOCK * w // 8
        words = np.frombuffer(b"".join(blocks[k][12:12 + size] for k in at), "<u8").reshape(len(at), -1)
        values = unpack_bits(words, w).astype(np.uint32)
        for row, k in enumerate(at.tolist()):
            base, _, far = heads[k]
            if far:
                where = np.frombuffer(blocks[k][12 + size:12 + size + 2 * far], "<u2")
                values[row, where] = np.frombuffer(blocks[k][12 + size + 2 * far:12 + size + 6 * far], "<u4")
            values[row] += np.uint32(base)
        out[at] = values
    return out.reshape(-1)


def file_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, percentile: float) -> bytes:
    blocks = encode_blocks(ids, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(blocks), starts[-1]], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        lengths.astype("<u8").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes; ids(i) and span(a, b) decode only the blocks they touch."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, n_blocks, size = np.frombuffer(view[8:40], "<u8").astype(int).tolist()
        at = [40, 40 + 8 * docs, 40 + 9 * docs, 40 + 17 * docs, 40 + 17 * docs + 8 * (n_blocks + 1)]
        if len(data) != at[-1] + size:
            raise ValueError("token file of the wrong length")
        null = np.frombuffer(view[at[1]:at[2]], "u1")
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(view[at[0]:at[1]], "<i8").tolist(), null)]
        self.lengths = np.frombuffer(view[at[2]:at[3]], "<u8").astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.starts, self.body = np.frombuffer(view[at[3]:at[4]], "<u8").astype(np.int64), view[at[4]:]

    def span(self, a: int, b: int) -> np.ndarray:
        first, last = a // BLOCK, -(-b // BLOCK)
        blocks = [self.body[self.starts[k]:self.starts[k + 1]] for k in range(first, last)]
        return decode_blocks(blocks)[a - first * BLOCK:b - first * BLOCK] if b > a else np.zeros(0, np.uint32)

    def ids(self, k: int) -> np.ndarray:
        return self.span(int(self.bounds[k]), int(self.bounds[k + 1]))


def write_ids(docs: DataFrame, path: str, end_id: int = 1, percentile: float = 0.9, folder: str | None = None,
              file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text (null: empty), append end_id, write files in ascending order of doc_id; the manifest.

    One task writes one range of doc_id, file by file.  A file is written under a name of its own and then moved to
    its final one, which depends on the task's number only, so a repeated task leaves the same file.  The manifest,
    rows (part, shard, file, docs, ids, start), is a table written by Spark: files that it does not name are not part
    of the result.  Null doc_ids come first; rows with equal doc_id go by the hash of their text and may be in
    several tasks.  An empty table has no file."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .withColumn("h", F.xxhash64("text"))
              .repartitionByRange(tasks(spark), F.asc_nulls_first("doc_id"), "h")
              .sortWithinPartitions(F.asc_nulls_first("doc_id"), "h").select("doc_id", "text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        system, top = pafs.FileSystem.from_uri(folder)
        held: dict = {"docs": [], "lengths": [], "ids": [], "n": 0, "shard": 0}

        def flush():
            name = f"part-{part:06d}-{held['shard']:05d}.pfor"
            system.create_dir(top, recursive=True)
            own = f"{top}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(file_bytes(held["docs"], np.concatenate(held["lengths"]), np.concatenate(held["ids"]),
                                     percentile))
            system.move(own, f"{top}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [held["shard"]], "file": [name],
                                              "docs": [len(held["docs"])], "ids": [held["n"]]})
            held.update(docs=[], lengths=[], ids=[], n=0, shard=held["shard"] + 1)
            return row.cast(pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()),
                                       ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for rows in pieces_of(batch, most=ENCODE_BYTES):
                bounds, ids = encode_texts(rows.column("text"), path)
                with_end = np.insert(ids, bounds[1:], end_id)
                held["docs"] += rows.column("doc_id").to_pylist()
                held["lengths"].append(np.diff(bounds) + 1)
                held["ids"].append(with_end)
                held["n"] += len(with_end)
                if held["n"] >= file_ids:
                    yield flush()
        if held["docs"]:
            yield flush()

    files = stored(ranged.mapInArrow(run, "part int, shard int, file string, docs long, ids long"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")
    parts = files.groupBy("part").agg(F.sum("ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    return files.withColumn("within", within).join(before, "part").select(
        "part", "shard", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "docs", "ids",
        (F.col("before") + F.col("within")).alias("start"))


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from files."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                system, at = pafs.FileSystem.from_uri(uri)
                with system.open_input_stream(at) as source:
                    file = TokenFile(source.read())
                for a in range(0, len(file.doc_ids), 1000):
                    b = min(a + 1000, len(file.doc_ids))
                    data = file.span(int(file.bounds[a]), int(file.bounds[b])).astype("<u4").tobytes()
                    cut = 4 * (file.bounds[a:b + 1] - file.bounds[a])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[a:b], pa.int64()), pa.array(start + file.bounds[a:b]),
                         pa.array(file.lengths[a:b]),
                         pa.array([data[x:y] for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    spread = manifest.select("file", "start").repartition(tasks(spark), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
