"""Cohort retention on a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import CohortTable, SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import attach


def typical_gap(dates: DataFrame, keys: list[str]) -> DataFrame:
    """Median day gap between distinct dates, truncated, at least 1."""
    lag = F.lag("ds").over(Window.partitionBy(*keys).orderBy("ds"))
    gaps = dates.select(*keys, "ds").distinct().select(*keys, F.datediff("ds", lag).alias("gap"))
    return gaps.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.coalesce(F.median("gap"), F.lit(1.0)).cast("int")).alias("gap")
    )


def calendar_periods(freq: str, start: Column, end: Column) -> Column:
    """Calendar periods from the one that holds `start` to the one that holds `end`."""
    start, end = cal.period_start(start, freq), cal.period_start(end, freq)
    months = {"MS": 1, "QS": 3, "YS": 12}.get(freq)
    if months:
        return F.round(F.months_between(end, start) / months).cast("bigint")
    return F.floor(F.datediff(end, start) / (7 if freq.startswith("W") else 1)).cast("bigint")


def cohort_analysis(sf: SalesFrame, cohort_col: str, count: str = "rows", offset: str = "gap",
                    zero_fill: bool = True) -> CohortTable:
    """Share of each cohort active per period since its first date.

    Every cohort has a row for every offset found; with `zero_fill=False` only for those at which it was active, so
    the table grows with the cells that are there and not with cohorts times offsets.

    Rows are counted (filler rows too), as the default; `count="distinct"`
    counts members instead.  Offsets are days by the typical gap between dates,
    or with `offset="calendar"` periods of the frame's frequency."""
    if cohort_col not in sf.df.columns:
        raise ValueError(f"no cohort_col '{cohort_col}' among {sf.df.columns}")
    if count not in ("rows", "distinct"):
        raise ValueError(f"count must be 'rows' or 'distinct', not {count!r}")
    if offset not in ("gap", "calendar"):
        raise ValueError(f"offset must be 'gap' or 'calendar', not {offset!r}")
    keys = [k for k in sf.keys if k != cohort_col]
    # One row per member and date: a member's window is bounded by the calendar.
    member_days = (
        sf.df.dropna(subset=["ds", cohort_col])
        .groupBy(*keys, cohort_col, "ds").agg(F.count(F.lit(1)).alias("rows"))
    )
    first = F.min("ds").over(Window.partitionBy(*keys, cohort_col))
    started = member_days.withColumn("cohort_start", first)
    if offset == "calendar":
        periods = calendar_periods(sf.freq, F.col("cohort_start"), F.col("ds"))
    else:
        started = attach(started, typical_gap(sf.df.dropna(subset=["ds"]), keys), keys, ["gap"])
        periods = F.expr("datediff(ds, cohort_start) div gap")
    cells = started.select(*keys, cohort_col, "cohort_start", periods.alias("period_offset"), "rows")
    if count == "distinct":
        cells = cells.groupBy(*keys, cohort_col, "cohort_start", "period_offset").agg(F.lit(1).alias("rows"))
    active = cells.groupBy(*keys, "cohort_start", "period_offset").agg(
        F.sum("rows").cast("bigint").alias("active")
    )
    table = _zero_filled(active, keys) if zero_fill else _sparse(active, keys)
    return CohortTable(table, tuple(keys))


def _sparse(active: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that are there.  A cohort has one at offset 0, so its size is among them."""
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(Window.partitionBy(*keys, "cohort_start"))
    return active.withColumn("cohort_size", size).withColumn(
        "retention", F.least(F.lit(1.0), F.col("active") / F.col("cohort_size")))


def _zero_filled(active: DataFrame, keys: list[str]) -> DataFrame:
    """All offsets for all cohorts.  Both sides are bounded by the calendar."""
    # `active` is never 0; naming it gives both branches the same columns, so that they
    # share one exchange and the cells are counted once
    present = F.when(F.col("active") > 0, F.col("period_offset"))
    offsets = active.groupBy(*keys).agg(F.sort_array(F.collect_set(present)).alias("offsets"))
    sizes = active.groupBy(*keys, "cohort_start").agg(
        F.sum(F.when(F.col("period_offset") == 0, F.col("active")).otherwise(F.lit(0))).alias("cohort_size")
    )
    grid = attach(sizes, offsets, keys, ["offsets"]).select(
        *keys, "cohort_start", F.explode("offsets").alias("period_offset"),
        F.lit(0).cast("bigint").alias("active"), "cohort_size",
    )
    cells = active.withColumn("cohort_size", F.lit(None).cast("bigint")).unionByName(grid)
    full = cells.groupBy(*keys, "cohort_start", "period_offset").agg(
        F.sum("active").alias("active"), F.max("cohort_size").alias("cohort_size")
    )
    rate = F.when(F.col("cohort_size") > 0, F.col("active") / F.col("cohort_size"))
    return full.withColumn("retention", F.least(F.lit(1.0), F.coalesce(rate, F.lit(0.0))))


def retention_matrix(table: CohortTable, offsets: list[int] | None = None, prefix: str = "") -> DataFrame:
    """Wide view: one column `prefix` + offset per period offset; by default for every offset that the table has, which
    a first pass finds."""
    if offsets is None:
        found = table.retention.select("period_offset").distinct().collect()
        offsets = sorted(r.period_offset for r in found)
    wide = table.retention.groupBy(*table.keys, "cohort_start").pivot("period_offset", offsets).agg(F.first("retention"))
    return wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in offsets}) if prefix else wide
