"""Whole series to numpy kernels, many at a time.

Rows are partitioned by series and sorted inside each partition; a task walks
over its Arrow batches, cuts them at series boundaries and hands series of equal
length to the kernel as one matrix.  Only the series under the cut is held over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..functions.ordering import spread


def key_fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def map_series(obs: DataFrame, keys: list[str], kernel: Callable, fields: str, matrix_cells: int = 20_000) -> DataFrame:
    """`kernel(y, rows)` gets a (series, n) matrix and the rows of those series
    (sorted, n per series) and returns a pandas frame of `keys…, fields`."""

    def flush(pdf) -> Iterator:
        import numpy as np

        if keys:
            new = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
            new[0] = True
        else:
            new = np.arange(len(pdf)) == 0
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(pdf)))
        values = pdf["y"].to_numpy()
        for n in np.unique(length):
            of_length = start[length == n]
            at_once = max(1, matrix_cells // n)
            for i in range(0, len(of_length), at_once):
                idx = of_length[i : i + at_once, None] + np.arange(n)
                yield kernel(values[idx], pdf.iloc[idx.ravel()].reset_index(drop=True))

    def run(batches) -> Iterator:
        import numpy as np
        import pandas as pd

        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            if keys:
                changes = np.flatnonzero(pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()[1:]) + 1
                same = not held or (held[-1][keys].iloc[-1] == pdf[keys].iloc[0]).all()
                cut = changes[-1] if len(changes) else 0
                if not same or cut:
                    done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
                    held = []
                    yield from flush(done)
                pdf = pdf.iloc[cut:]
            held.append(pdf)
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    rows = spread(obs.select(*keys, "ds", "y"), keys).sortWithinPartitions(*keys, "ds", "y")
    return rows.mapInPandas(run, key_fields(obs, keys) + fields)
