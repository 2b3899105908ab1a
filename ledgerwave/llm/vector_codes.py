"""Vector codes by Lloyd's method on integer parts, comparing only what can have changed.

Vectors become integers, are cut into equal parts, and every part position has its own codebook.  A row carries the
entries its parts are assigned to and the exact squared distances.  When the codebooks move, a part whose entry stayed
compares the moved entries with its stored distance and nothing else: all other entries are where they were when it
lost to none of them.  A part whose entry moved scans the codebook again.  Every pass reads the table of the last one,
writes the next with the sums of its task beside it, and drops the last: no row is shuffled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_table, small_batches, stored, stored_at

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STATE = "vec_id long, label {label}, q array<bigint>, entries array<bigint>, distances array<bigint>, sums array<bigint>"


def width(length: int, parts: int) -> int:
    """Components of a part.  A length that is no multiple of `parts` is filled up with zeros at its end."""
    return -(-length // parts)


def largest(length: int, parts: int) -> int:
    """Integer components are held within this, so that a squared distance summed over a vector fits in 63 bits."""
    return math.isqrt((1 << 61) // max(1, parts * width(length, parts)))


def integers(rows: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix, (rows, parts * width)."""
    bound = float(largest(rows.shape[1], parts))
    with np.errstate(over="ignore"):
        out = np.clip(np.floor(rows.astype(np.float64) * scale), -bound, bound).astype(np.int64)
    return np.pad(out, ((0, 0), (0, parts * width(rows.shape[1], parts) - rows.shape[1])))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries).  Floats hold them where no sum passes 2**53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, dist: np.ndarray) -> None:
    """Nearest entry of each row of x, in place in `entry` and `dist`; entry -1 is not assigned yet.  Ties go to the
    lower index."""
    again = (entry < 0) | moved[entry]
    if again.any():
        d = distances(x[again], book)
        entry[again] = d.argmin(1)
        dist[again] = d.min(1)
    active = np.flatnonzero(moved)
    stay = np.flatnonzero(~again)
    if len(active) and len(stay):
        d = distances(x[stay], book[active])
        best, first = d.min(1), active[d.argmin(1)]
        better = (best < dist[stay]) | ((best == dist[stay]) & (first < entry[stay]))
        entry[stay[better]], dist[stay[better]] = first[better], best[better]


def pass_over(rows: DataFrame, books: dict[int, np.ndarray], moved: dict[int, np.ndarray], schema: str,
              want_sums: bool) -> DataFrame:
    """Rows assigned to the codebooks of their length, and one row of sums for each length that a task has seen.
    Sums are (parts, entries, 1 + width): count, then componentwise sums, after the length itself."""
    sent = rows.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches):
        all_books, all_moved = sent.value
        sums: dict[int, np.ndarray] = {}
        label_type = None
        for batch in batches:
            label_type = batch.schema.field("label").type
            q = batch.column("q")
            length = np.diff(q.offsets.to_numpy())
            flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.concatenate([[0], np.cumsum(length)])[:-1]
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                book, turned = all_books[int(d)], all_moved[int(d)]
                parts, k, w = book.shape
                x = flat[begins[at][:, None] + np.arange(d)].reshape(len(at), parts, w)
                part = batch.take(pa.array(at))
                entry = part.column("entries").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(
                    -1, parts).copy()
                dist = part.column("distances").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(
                    -1, parts).copy()
                for p in range(parts):
                    e, s = entry[:, p].copy(), dist[:, p].copy()
                    assign(x[:, p], book[p], turned[p], e, s)
                    entry[:, p], dist[:, p] = e, s
                    if want_sums:
                        total = sums.setdefault(int(d), np.zeros((parts, k, 1 + w), np.int64))
                        total[p, :, 0] += np.bincount(e, minlength=k)
                        order = np.argsort(e, kind="stable")
                        used, first = np.unique(e[order], return_index=True)
                        if w:
                            total[p, used, 1:] += np.add.reduceat(x[order, p], first, axis=0)
                step = pa.array(np.arange(0, parts * len(at) + 1, parts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("q"),
                     pa.ListArray.from_arrays(step, pa.array(entry.reshape(-1))),
                     pa.ListArray.from_arrays(step, pa.array(dist.reshape(-1))),
                     pa.nulls(len(at), pa.list_(pa.int64()))],
                    ["vec_id", "label", "q", "entries", "distances", "sums"])
        for d, total in sums.items():
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, label_type), pa.nulls(1, lists), pa.nulls(1, lists),
                 pa.nulls(1, lists), pa.array([np.concatenate([[d], total.reshape(-1)])], lists)],
                ["vec_id", "label", "q", "entries", "distances", "sums"])

    return rows.mapInArrow(run, schema)


def summed(state: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The tasks' sums added up: numbers of a codebook, whatever the number of tasks and rows."""
    cells = state.where("sums IS NOT NULL").select(
        F.element_at("sums", 1).alias("d"), F.posexplode(F.slice("sums", 2, F.size("sums") - 1)).alias("at", "v"))
    total = {d: np.zeros(b.shape[:2] + (1 + b.shape[2],), np.int64) for d, b in books.items()}
    for r in cells.groupBy("d", "at").agg(F.sum("v").alias("v")).where("v <> 0").toLocalIterator():
        total[r.d].reshape(-1)[r.at] = r.v
    return total


def next_books(books: dict[int, np.ndarray], sums: dict[int, np.ndarray]) -> tuple[dict, dict]:
    """(codebooks, which entries moved): floors of the means, unused entries stay."""
    out, moved = {}, {}
    for d, book in books.items():
        count = sums[d][:, :, :1]
        out[d] = np.where(count > 0, sums[d][:, :, 1:] // np.maximum(count, 1), book)
        moved[d] = (out[d] != book).any(2)
    return out, moved


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the vectors without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.coalesce(~bad, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("embedding"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector without null or non-finite components.

    A null vector, or one with a null or non-finite component, has no row.  Codebooks start as the vectors of the
    smallest ids (null ids last, equal ids by their integers); with fewer vectors they have fewer entries.  Vectors of
    different lengths (filled up with zeros to a multiple of `parts`; the empty one included) have codebooks of their
    own, so driver and workers hold `entries` vectors for each length that occurs.  Repeated rows count like others, equal labels (null ones together) share a
    label_error, null where it passes 63 bits.  Components beyond sqrt(2**61 / length) after scaling are held there.
    Other columns are not read.  An empty table gives no rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    label = vectors.schema["label"].dataType.simpleString()
    schema = STATE.format(label=label)

    def quantise(batches):
        for batch in batches:
            column = batch.column("embedding")
            length = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.concatenate([[0], np.cumsum(length)])[:-1]
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                q = integers(flat[begins[at][:, None] + np.arange(d)], parts, scale)
                part = batch.take(pa.array(at))

                def lists(grid):
                    return pa.ListArray.from_arrays(
                        pa.array(np.arange(len(grid) + 1) * grid.shape[1], pa.int32()), pa.array(grid.reshape(-1)))

                unset = np.full((len(at), parts), -1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), lists(q), lists(unset), lists(unset),
                     pa.nulls(len(at), pa.list_(pa.int64()))],
                    ["vec_id", "label", "q", "entries", "distances", "sums"])

    state, path = stored_at(finite_vectors(vectors).mapInArrow(quantise, schema))
    books, moved = {}, {}
    for r in state.select(F.size("q").alias("d")).distinct().collect():
        first = state.where(F.size("q") == r.d).orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries)
        rows = [x.q for x in first.collect()]
        books[r.d] = np.array(rows, np.int64).reshape(len(rows), parts, r.d // parts).transpose(1, 0, 2).copy()
        moved[r.d] = np.ones(books[r.d].shape[:2], bool)
    for k in range(rounds + 1):
        last = path
        state, path = stored_at(pass_over(state.where("sums IS NULL"), books, moved, schema, k < rounds))
        drop_table(spark, last)
        if k < rounds:
            books, moved = next_books(books, summed(state, books))
    code = F.concat(*[F.lpad(F.lower(F.hex(F.element_at("entries", p + 1))), 2, "0") for p in range(parts)])
    done = state.select("vec_id", "label", code.alias("code"), F.size("q").alias("d"), F.aggregate(
        "distances", F.lit(0).cast("long"), lambda s, x: s + x).alias("error"))
    by_label = stored(done.groupBy("label").agg(
        F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)").alias("label_error")).withColumnRenamed(
        "label", "its_label"))
    names = F.create_map(*[F.lit(x) for d, b in books.items() for x in (d, digest(b))]) if books else None
    sha = F.element_at(names, F.col("d")) if books else F.lit("")
    return done.join(by_label, F.col("label").eqNullSafe(F.col("its_label"))).select(
        "vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
