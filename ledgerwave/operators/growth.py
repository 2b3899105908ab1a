"""Rolling growth, compound annual growth and turning points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import GrowthMetrics, SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import dealt, into_blocks, positions, previous_value


def relative_change(y: Column, prev: Column) -> Column:
    """y/prev - 1; a zero base gives ±infinity, 0/0 gives NULL."""
    return (
        F.when(prev != 0, y / prev - 1)
        .when((prev == 0) & (y > 0), F.lit(float("inf")))
        .when((prev == 0) & (y < 0), F.lit(float("-inf")))
    )


def compound_growth(first: Column, last: Column, n: Column, per_year: int, floor: float) -> Column:
    """Annual growth from first to last value over n periods; NULL if undefined."""
    years = F.greatest(n / F.lit(float(per_year)), F.lit(floor))
    g = F.pow(last / first, F.lit(1.0) / years) - 1
    return F.when((n >= 2) & (first > 0) & (last >= 0), g)


def first_and_last(obs: DataFrame, group: list[str]) -> DataFrame:
    order = F.struct("ds", "y")
    return obs.groupBy(*group).agg(
        F.min_by("y", order).alias("first_y"),
        F.max_by("y", order).alias("last_y"),
        F.count("y").alias("n"),
    )


def growth_metrics(sf: SalesFrame, window: int = 4) -> GrowthMetrics:
    keys = list(sf.keys)
    obs = sf.observed()
    y = F.col("y")
    if sf.calendar_bounded:
        w = Window.partitionBy(*keys).orderBy("ds", "y")
        g = obs.withColumn("growth", relative_change(y, F.lag("y", window).over(w))).where("growth IS NOT NULL")
        prev = F.lag("growth").over(w)
        rolling = g.select(
            *keys, "ds", "growth", F.coalesce(F.col("growth") * prev < 0, F.lit(False)).alias("is_inflection")
        )
    else:
        # Long series: cut by position into blocks that overlap by `window` rows,
        # so one key is spread over many tasks.
        d = dealt(into_blocks(positions(obs, keys, False), window), *keys, "__block")
        w = Window.partitionBy(*keys, "__block").orderBy("pos")
        d = d.withColumn("growth", relative_change(y, F.lag("y", window).over(w)))
        d = d.where("__home AND growth IS NOT NULL").select(*keys, "ds", "growth", "pos", "__block")
        rolling = previous_value(d, keys, "growth", "prev").select(
            *keys, "ds", "growth",
            F.coalesce(F.col("growth") * F.col("prev") < 0, F.lit(False)).alias("is_inflection"),
        )
    summary = first_and_last(obs, keys).select(
        *keys,
        compound_growth(
            F.col("first_y"), F.col("last_y"), F.col("n"), cal.periods_per_year(sf.freq), 0.01
        ).alias("cagr"),
        F.col("n").alias("n_points"),
    )
    return GrowthMetrics(rolling, summary, window, tuple(keys))
