"""Additive Holt-Winters smoothing as folds over sorted series.

A series is one row with its values as an array, bounded by the calendar.  A fold keeps level, slope and a ring of one
cycle of seasonal states.  Parameters are searched by least squares: a coarse grid, then finer grids around the best
set of each series.  The search goes through the Arrow batches of a task: series of equal length and season are a
matrix, and one step moves the folds of all of them under all sets of a grid.  Nothing is shuffled between rounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Level, slope and seasonal smoothing of the first round, steps to both sides in the next ones, and their limits.
COARSE = (0.05, 0.2, 0.4, 0.6, 0.9)
FINER = (0.1, 0.05, 0.02)
LOWEST, HIGHEST = 0.01, 0.99
#: Cycles that start a seasonal model, values that start another.
START_CYCLES, START_VALUES = 5, 10
#: Folds that are moved together, a few arrays of them in a processor's cache.
FOLDS = 8_000


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def states(l: Column, b: Column, ring: Column) -> Column:
    return F.struct(l.alias("l"), b.alias("b"), ring.alias("ring"))


def first_states(y: Column, n: Column, m: Column) -> Column:
    """Level before the first value, slope and one cycle of seasonal states.

    A season of m periods: the slope between the first two cycles, and the means by phase of what the first cycles
    leave over their line.  Otherwise (m = 1): the line through the first values."""
    cycles = F.least(F.floor(n / m), F.lit(START_CYCLES)).cast("int")
    count = cycles * m
    slope = (total(F.slice(y, m + 1, m)) - total(F.slice(y, F.lit(1), m))) / (m * m)
    mean = total(F.slice(y, F.lit(1), count)) / count

    def seasonal(slope, mean):
        def over(at):
            return F.element_at(y, at + 1) - (mean + slope * (at - (count - 1) / 2))

        raw = F.transform(F.sequence(F.lit(0), m - 1), lambda j: total(
            F.transform(F.sequence(F.lit(0), cycles - 1), lambda c: over(c * m + j))) / cycles)
        centred = bind(raw, lambda r: bind(total(r) / m, lambda c: F.transform(r, lambda v: v - c)))
        return states(mean - slope * ((count - 1) / 2) - slope, slope, centred)

    k = F.least(n, F.lit(START_VALUES))
    head = F.slice(y, F.lit(1), k)
    centre, height = (k + 1) / 2, total(head) / k
    tilt = total(F.transform(head, lambda v, i: (i + 1 - centre) * (v - height))) / (
        total(F.transform(head, lambda v, i: (i + 1 - centre) * (i + 1 - centre))))
    line = bind(tilt, lambda t: states(height - t * centre, t, F.array(F.lit(0.0))))
    return F.when(m > 1, bind(slope, lambda s: bind(mean, lambda v: seasonal(s, v)))).otherwise(line)


def folded(y: Column, start: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """States after the last value, with the sums of the one-step errors (s1) and of their squares (s2)."""
    zero = F.struct(start["l"].alias("l"), start["b"].alias("b"), start["ring"].alias("ring"), F.lit(0.0).alias("s1"),
                    F.lit(0.0).alias("s2"))

    def advance(s, v):
        ring = s["ring"]
        return bind(v - s["l"] - s["b"] - ring[0], lambda e: F.struct(
            (s["l"] + s["b"] + alpha * e).alias("l"), (s["b"] + alpha * beta * e).alias("b"),
            F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.array(ring[0] + gamma * e)).alias("ring"),
            (s["s1"] + e).alias("s1"), (s["s2"] + e * e).alias("s2")))

    return F.aggregate(y, zero, advance)


def squared_errors(y, ring, level, slope, a, b, g):
    """Sums of the squared one-step errors of `folded`, in the same order of operations: `y` is (series, n), `ring`
    (m, series), the smoothing (series, sets)."""
    import numpy as np

    l, s, ab = (np.broadcast_to(v, a.shape).copy() for v in (level[:, None], slope[:, None], a * b))
    turns = [np.broadcast_to(r[:, None], a.shape).copy() for r in ring]
    total, e, part = np.zeros(a.shape), np.empty(a.shape), np.empty(a.shape)
    for i, now in enumerate(np.ascontiguousarray(y.T)):
        r = turns[i % len(turns)]
        np.subtract(now[:, None], l, out=e)
        e -= s
        e -= r
        l += s
        l += np.multiply(a, e, out=part)
        s += np.multiply(ab, e, out=part)
        r += np.multiply(g, e, out=part)
        total += np.multiply(e, e, out=part)
    return total


def searched(y, ring, level, slope):
    """(a, b, g, sse) of each series, the first of equal sets; arguments as in `squared_errors`."""
    import numpy as np

    sides = np.array([-1.0, 0.0, 1.0])

    def axis(value, width):
        return np.minimum(np.maximum(value[:, None] + sides * width, LOWEST), HIGHEST)

    count, seasonal = len(y), len(ring) > 1
    axes = [np.broadcast_to(np.array(COARSE), (count, len(COARSE)))] * 3
    every = np.arange(count)
    for width in (*FINER, None):
        alphas, betas, gammas = (*axes[:2], axes[2] if seasonal else np.zeros((count, 1)))
        shape = (count, alphas.shape[1], betas.shape[1], gammas.shape[1])
        sets = [np.ascontiguousarray(np.broadcast_to(v, shape)).reshape(count, -1) for v in (
            alphas[:, :, None, None], betas[:, None, :, None], gammas[:, None, None, :])]
        sse = squared_errors(y, ring, level, slope, *sets)
        # Sums that are not numbers are the largest, as in Spark's order.
        known = ~np.isnan(sse)
        low = np.where(known, sse, np.inf)
        best = np.where(np.isinf(low.min(axis=1)), known.argmax(axis=1), low.argmin(axis=1))
        found = [v[every, best] for v in sets]
        if width:
            axes = [axis(v, width) for v in found]
    return [*found, sse[every, best]]


def _search(batches) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def values(column):
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    for batch in batches:
        (at, y), (ring_at, ring) = values(batch.column("y")), values(batch.column("__ring"))
        level, slope = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__level", "__slope"))
        kinds = np.stack([np.diff(at), np.diff(ring_at)], axis=1)
        out = np.empty((4, len(kinds)))
        at_once = FOLDS // len(COARSE) ** 3
        with np.errstate(all="ignore"):
            for n, m in np.unique(kinds, axis=0):
                alike = np.flatnonzero((kinds == (n, m)).all(axis=1))
                for rows in (alike[i : i + at_once] for i in range(0, len(alike), at_once)):
                    out[:, rows] = searched(
                        y[at[rows, None] + np.arange(n)], ring[ring_at[rows, None] + np.arange(m)].T, level[rows], slope[rows])
        kept = [c for c in batch.schema.names if c not in ("__ring", "__level", "__slope")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), *(pa.array(v) for v in out)], names=[*kept, "a", "b", "g", "sse"])


def fit(series: DataFrame) -> DataFrame:
    """Adds a, b, g (least squares over the grids; the smallest of equal ones), and `state`, the states after the last
    value.  `series` has y (array), n and m (1: no season; its smoothing is then 0)."""
    d = series.withColumn("start", first_states(F.col("y"), F.col("n"), F.col("m")))
    fields = [*d.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("a", "b", "g", "sse")]]
    found = d.withColumns({"__ring": F.col("start.ring"), "__level": F.col("start.l"), "__slope": F.col("start.b")}).mapInArrow(
        _search, T.StructType(fields))
    return found.withColumn(
        "state", folded(F.col("y"), F.col("start"), F.col("a"), F.col("b"), F.col("g"))).drop("start")
