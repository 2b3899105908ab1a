"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stored import shared_folder, stored, stored_at  # noqa: F401

#: Python side work goes through batches in pieces of about this many bytes of text.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows instead of the default: rows hold whole texts, and both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, "1000")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of stored_at that no later step reads, through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def worker_cache(name: str, make):
    """What make() gave the first time in this Python process.  Functions reach workers by value, so globals of
    their modules do not outlive a task; this store does."""
    store = sys.modules.setdefault("_ledgerwave_worker", types.ModuleType("_ledgerwave_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def pieces_of(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The rows of a batch in runs of about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def filled(texts: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets and null as the empty text, copied: some of Arrow's text functions misread the
    buffers of a slice."""
    texts = texts.cast(pa.large_string())
    return pc.if_else(pc.is_null(texts), pa.scalar("", pa.large_string()), texts)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), a != b: rows (node, component), the component its smallest node.

    Two-phase star contraction.  Every node hooks its larger neighbours to its smallest neighbour, then its smaller
    neighbours, until all edges are stars; each phase is two aggregates and a join, so a hub's edges are rows like
    others and are never gathered.  Edge lists are written between rounds; a round ends with one count.  Null ends
    and loops are ignored, repeated edges count once."""
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    known = stored(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = known.union(known.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.union(low.where("m < a")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = stored(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        ends = nxt.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        open_edges = ends.where("n > 1").limit(1).count() or nxt.join(
            nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        known = nxt
        if not open_edges:
            return known.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                known.select("b", "b").distinct())
