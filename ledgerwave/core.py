"""Value types of the engine.

A `SalesFrame` is a lazy DataFrame in long form plus the few facts an operator
needs at plan time.  Columns are always::

    keys…  [segment_col]  ds DATE  y DOUBLE  is_gap BOOLEAN

`keys` identify independent series, so one job handles any number of them.
`segment_col` is an attribute *inside* a series: operators that do not look at
segments pool them, `compare_segments` ranks them, gaps are filled per segment.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

NO_FINDINGS = "No notable findings."


@dataclass(frozen=True)
class SalesFrame:
    df: DataFrame
    freq: str
    keys: tuple[str, ...] = ()
    segment_col: str | None = None
    # True when (keys, segment, ds) is unique.  Set by operators that aggregate
    # to one row per period; never guessed.
    one_row_per_date: bool = False

    @property
    def group_keys(self) -> list[str]:
        """Keys of one gap-free calendar: series keys plus the segment."""
        return [*self.keys, *([self.segment_col] if self.segment_col else [])]

    @property
    def calendar_bounded(self) -> bool:
        """A series has at most one row per date, so its length is bounded by
        the calendar and one window partition per series is safe."""
        return self.one_row_per_date and self.segment_col is None

    def observed(self) -> DataFrame:
        """Rows with a value, reduced to keys, date and value."""
        return self.df.where("y IS NOT NULL").select(*self.keys, "ds", "y")

    def with_df(self, df: DataFrame) -> "SalesFrame":
        return replace(self, df=df)


@dataclass(frozen=True)
class Decomposition:
    components: DataFrame  # keys…, ds, y, trend, seasonal, residual
    period: int
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class AnomalyTable:
    anomalies: DataFrame  # keys…, ds, y, score, method, label, threshold
    method: str
    threshold: float
    series: DataFrame  # one row per analysed series (keys…, n)
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class GrowthMetrics:
    rolling: DataFrame  # keys…, ds, growth, is_inflection
    summary: DataFrame  # keys…, cagr, n_points
    window: int
    keys: tuple[str, ...] = ()

    @property
    def inflection_points(self) -> DataFrame:
        return self.rolling.where("is_inflection").select(*self.keys, "ds")


@dataclass(frozen=True)
class SegmentRanking:
    summary: DataFrame  # keys…, segment, cagr, latest_value, trend_direction
    ranked_by: str
    keys: tuple[str, ...] = ()

    @property
    def order(self) -> Column:
        """Sort key, best first: descending metric, missing last, then name."""
        metric = F.col(self.ranked_by)
        return F.struct(metric.isNull(), -metric, F.col("segment"))

    def sorted(self) -> DataFrame:
        return self.summary.orderBy(*self.keys, self.order)


@dataclass(frozen=True)
class Forecast:
    forecast: DataFrame  # keys…, step, ds, yhat, lower, upper
    rejected: DataFrame  # keys…, n, reason
    horizon: int
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class CohortTable:
    retention: DataFrame  # keys…, cohort_start, period_offset, active, cohort_size, retention
    keys: tuple[str, ...] = ()
