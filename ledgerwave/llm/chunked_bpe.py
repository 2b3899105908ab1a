"""Byte-level BPE of long texts in parallel: overlapping chunks, stitched where their pre-tokens agree.

A text longer than a chunk is cut into chunks that overlap.  Each chunk is pre-tokenised by itself.  From the first
pre-token boundary that two neighbours share in their overlap on, they agree for good, since the pattern looks only
ahead; there, before white space, the text is cut.  The pieces are encoded where they lie, and a document's ids are its pieces' ids in
order.  Chunks whose overlap shares no such boundary (one run of letters, say) are encoded as one piece."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces_of, stored, tasks, worker_cache

CHUNK, OVERLAP = 20_000, 400


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    def make():
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    return worker_cache(f"ranks {path} {pattern}", make)


def boundaries(text: str, pattern, start: int, stop: int) -> list[int]:
    """Ends of pre-tokens in [start, stop) where white space follows something else.

    No pre-token goes on over such a place, whatever stands before the chunk, and ending the text there changes no
    pre-token before it."""
    return [e for m in pattern.finditer(text) if start <= (e := m.end()) < stop and e < len(text)
            and text[e] in " \t\r\n" and not text[e - 1].isspace()]


def encode_ids(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (unsigned 32-bit) for every row.

    Null texts are empty.  Rows with null or repeated doc_id are encoded like others, equal rows once and then
    repeated.  Other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_text = F.length("text") > chunk + overlap

    def encode(batches, columns):
        enc = encoding(path, pattern)
        for batch in batches:
            for rows in pieces_of(batch):
                ids = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(ids, pa.binary())],
                                                 [*columns, "ids"])

    short = docs.where(~long_text).mapInArrow(lambda b: encode(b, ["doc_id"]), "doc_id long, ids binary")

    # One row for each long text, its number of copies and its chunks with the overlap behind them.
    texts = docs.where(long_text).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    chunks = texts.withColumn("key", F.struct("doc_id", F.md5("text").alias("text"))).select(
        "key", "copies", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")),
            lambda k: F.substring(F.col("text"), k * chunk + 1, F.lit(chunk + overlap)))).alias("k", "text"))
    chunks = chunks.repartition(tasks(spark), "key", "k")

    def cuts(batches):
        import regex

        pat = regex.compile(pattern)
        for batch in batches:
            for rows in pieces_of(batch):
                held = rows.column("text").to_pylist()
                near = [boundaries(t, pat, 1, overlap) for t in held]
                tail = [[e - chunk for e in boundaries(t, pat, chunk + 1, chunk + overlap)] for t in held]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("key", "copies", "k", "text")), pa.array(near, kind),
                     pa.array(tail, kind)], ["key", "copies", "k", "text", "near", "tail"])

    fields = "key struct<doc_id:long,text:string>, copies long, k int, text string"
    seen = stored(chunks.mapInArrow(cuts, f"{fields}, near array<int>, tail array<int>"))
    order = Window.partitionBy("key").orderBy("k")
    joint = F.array_min(F.array_intersect("near", F.lag("tail").over(order)))  # cut between a chunk and the one before
    marks = seen.select("key", "k", joint.alias("cut"))
    marks = marks.withColumn("next", F.lead("cut").over(order)).withColumn("last", F.lead("k").over(order).isNull())
    # A chunk without a cut before it belongs to the piece of the chunk before.
    begins = F.when((F.col("k") == 0) | F.col("cut").isNotNull(), 1).otherwise(0)
    marks = marks.withColumn("piece", F.sum(begins).over(order))
    first = F.coalesce("cut", F.lit(0))
    until = F.when(F.col("last"), F.lit(chunk + overlap)).otherwise(chunk + F.coalesce("next", F.lit(0)))
    parts = seen.join(marks, ["key", "k"]).withColumn("a", first).withColumn("b", until).select(
        "key", "copies", "piece", "k", F.expr("substring(text, a + 1, b - a)").alias("text"))
    pieces = parts.groupBy("key", "piece").agg(
        F.max("copies").alias("copies"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), "").alias("text"))
    coded = pieces.mapInArrow(lambda b: encode(b, ["key", "piece", "copies"]),
                              "key struct<doc_id:long,text:string>, piece long, copies long, ids binary")
    whole = coded.groupBy("key").agg(F.max("copies").alias("copies"), F.array_sort(
        F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    joined = whole.select(
        F.col("key.doc_id").alias("doc_id"),
        F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return short.union(joined.select("doc_id", "ids"))


def decode_ids(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded with n_tokens, ids_sha256, decoded (bytes) and decoded_sha256: decoding concatenates raw bytes."""

    def run(batches):
        words = worker_cache(f"bytes {path}", lambda: np.array(
            [b for b, _ in sorted(load_ranks(path).items(), key=lambda x: x[1])], object))
        names = worker_cache("decimals", lambda: np.array([str(k) for k in range(len(words))], object))
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            text = [b"".join(words[x].tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(" ".join(names[x].tolist()).encode()).hexdigest() for x in ids], pa.string()),
                pa.array(text, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])

    return coded.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")
