"""Trend decomposition: robust STL, or a centred mean where cycles are too few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..core import Decomposition, SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import one_per_date, positions, sliding_mean, with_stats
from .batches import map_series


def centred_mean(placed: DataFrame, keys: list[str], width: int, whole_series_fits: bool) -> DataFrame:
    before, after = width // 2, (width - 1) // 2
    if whole_series_fits:
        w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-before, after)
        d = placed.withColumn("trend", F.avg("y").over(w))
    else:
        d = sliding_mean(placed, keys, before, after, "trend")
    return d.select(
        *keys, "ds", "y", "trend", F.lit(0.0).alias("seasonal"), (F.col("y") - F.col("trend")).alias("residual")
    )


def stl_components(obs: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Robust STL of every series.  Parallel over series; a series is one task."""
    from .kernels import stl

    def decompose(y, rows):
        trend, seasonal = stl(y, period)
        return rows.assign(
            trend=trend.ravel(), seasonal=seasonal.ravel(), residual=(y - trend - seasonal).ravel()
        )

    return map_series(obs, keys, decompose, "ds date, y double, trend double, seasonal double, residual double")


def decompose_trend(sf: SalesFrame, period: int | str = "auto", duplicates: str = "sum") -> Decomposition:
    """Trend, seasonal part and residual of every series.  Cycles are defined over
    dates: for a period above 1, rows that share a date count as one, the
    `duplicates` "sum" or "mean" of them."""
    keys = list(sf.keys)
    p = cal.seasonal_period(sf.freq) if period == "auto" else int(period)
    width = max(3, p // 2)
    obs = sf.observed()
    bounded = sf.calendar_bounded
    if p <= 1:
        placed = positions(obs, keys, bounded)
        return Decomposition(centred_mean(placed, keys, width, bounded), p, tuple(keys))
    if not bounded:
        obs = one_per_date(obs, keys, duplicates)
    sized = with_stats(obs, keys, [], {"n": F.count(F.lit(1))}, True)
    # fewer than 2·p rows, so the window below is bounded by the period
    short = sized.where(F.col("n") < 2 * p)
    placed = positions(short, keys, True)
    long = sized.where(F.col("n") >= 2 * p).select(*keys, "ds", "y")
    parts = centred_mean(placed, keys, width, True).unionByName(stl_components(long, keys, p))
    return Decomposition(parts, p, tuple(keys))
