"""From rows to gap-free series: frequency, calendar, bounded forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..core import SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import attach, dealt, repeat_rows
from ..sources.tables import read_table, typed_rows

MIN_PERIODS = 4
_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def date_profile(rows: DataFrame) -> DataFrame:
    """One row `(n_dates, median_gap, anchor)` over the distinct dates of the
    whole table.  Only distinct dates reach the window, so its single partition
    is bounded by the calendar."""
    dates = rows.where("ds IS NOT NULL").select("ds").distinct()
    gaps = dates.select(
        "ds",
        F.weekday("ds").alias("wd"),
        F.datediff("ds", F.lag("ds").over(Window.orderBy("ds"))).alias("gap"),
    )
    # most frequent weekday, ties to the one seen first
    days = F.array(*[
        F.struct(
            F.count_if(F.col("wd") == i).alias("n"),
            (-F.unix_date(F.min(F.when(F.col("wd") == i, F.col("ds"))))).alias("seen"),
            F.lit(name).alias("name"),
        )
        for i, name in enumerate(cal.WEEKDAYS)
    ])
    return gaps.agg(
        F.count("ds").alias("n_dates"),
        F.median("gap").alias("median_gap"),
        F.array_max(days)["name"].alias("anchor"),
    )


def infer_freq(rows: DataFrame) -> DataFrame:
    """One row `(n_dates, median_gap, freq)`."""
    gap = F.col("median_gap")
    name = F.when(F.col("n_dates") < 2, F.lit("D"))
    for limit, freq in cal.GAP_LIMITS:
        name = name.when(gap <= limit, F.concat(F.lit("W-"), "anchor") if freq == "W" else F.lit(freq))
    return date_profile(rows).select("n_dates", "median_gap", name.otherwise(F.lit("YS")).alias("freq"))


def resolve_freq(rows: DataFrame, freq: str | None) -> str:
    """Plan-time frequency; reads one row unless the caller names it fully."""
    if freq is None:
        return infer_freq(rows).first().freq
    if freq == "W":
        return "W-" + date_profile(rows).first().anchor
    return cal.canonical(freq)


def regularise(
    rows: DataFrame,
    freq: str,
    keys: list[str] = (),
    max_fill: int = 3,
    strict_gaps: bool = False,
    one_row_per_date: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Calendar filling and bounded forward fill of `(keys…, ds, y)`.

    Every observed row stays, also rows that share a date.  Grid dates without
    a row are added, and at most `max_fill` consecutive missing rows take the
    last value before them (`strict_gaps`: only if the whole gap is that short).

    All ordered work happens on one row per (keys, date): the counts of missing
    and present values and the last value.  Rows with a value never take part
    in a shuffle beyond that map-side combined aggregate.  Rows that are `unique`
    by (keys, date) are taken as they are.  One sort serves all windows.
    """
    keys = list(keys)
    clean = rows.dropna(subset=["ds", *keys])
    if unique:
        daily, last_y = clean.select(*keys, "ds", "y"), F.col("y")
        has_val, n_null = F.isnotnull("y"), F.isnull("y").cast("int")
    else:
        daily = clean.groupBy(*keys, "ds").agg(
            F.count("y").alias("n_val"),
            F.count_if(F.isnull("y")).alias("n_null"),
            F.max("y").alias("last_y"),  # rows of one date are ordered by value, NULL first
        )
        has_val, n_null, last_y = F.col("n_val") > 0, F.col("n_null"), F.col("last_y")
    by_date = Window.partitionBy(*keys).orderBy("ds")
    earlier = by_date.rowsBetween(Window.unboundedPreceding, -1)
    d = (dealt(daily, *keys) if keys else daily).select(
        "*",
        F.lag("ds").over(by_date).alias("prev_ds"),
        F.last(F.when(has_val, last_y), ignorenulls=True).over(earlier).alias("prev_y"),
        # dates after one date with a value, up to and with the next one
        *([F.count(F.when(has_val, 1)).over(earlier).alias("island")] if strict_gaps else []),
    )
    none = F.array().cast("array<date>")
    d = d.withColumn(
        "new_dates", F.coalesce(cal.grid(F.date_add("prev_ds", 1), F.date_sub("ds", 1), freq), none)
    )
    # In an island all missing rows precede the value: new dates, then NULL rows of
    # a date (rows of one date are ordered by value, NULL first).  Those before a
    # date are what was missing so far without what was up to the last value.
    missing = n_null + F.size("new_dates")
    d = d.withColumn("so_far", F.coalesce(F.sum(missing).over(earlier), F.lit(0)))
    at_value = F.last(F.when(has_val, F.col("so_far") + missing), ignorenulls=True).over(earlier)
    d = d.withColumn("before", F.col("so_far") - F.coalesce(at_value, F.lit(0)))
    fillable = F.col("prev_y").isNotNull()
    if strict_gaps:
        d = d.withColumn("gap", F.sum(missing).over(Window.partitionBy(*keys, "island")))
        fillable = fillable & (F.col("gap") <= max_fill)

    new_rows = F.transform(
        "new_dates",
        lambda x, i: F.struct(
            x.alias("ds"), F.when(fillable & (F.col("before") + i < max_fill), F.col("prev_y")).alias("y")
        ),
    )
    room = F.lit(max_fill) - F.col("before") - F.size("new_dates")
    filled = F.when(fillable, F.greatest(F.lit(0), F.least(n_null, room))).otherwise(F.lit(0))

    if one_row_per_date:
        own = F.struct(
            F.col("ds"),
            F.when(has_val, last_y).when(filled > 0, F.col("prev_y")).alias("y"),
            (~has_val).alias("is_gap"),
        )
        added = F.transform(new_rows, lambda r: F.struct(r["ds"].alias("ds"), r["y"].alias("y"), F.lit(True).alias("is_gap")))
        return d.select(*keys, F.inline(F.concat(F.array(own), added)))

    values = clean.where("y IS NOT NULL").select(*keys, "ds", "y", F.lit(False).alias("is_gap"))
    added = d.select(*keys, F.inline(new_rows)).select(*keys, "ds", "y", F.lit(True).alias("is_gap"))
    # NULL rows of one date are interchangeable: rebuild them from their count
    nulls = d.where("n_null > 0").select(*keys, "ds", "n_null", "prev_y", filled.alias("filled"))
    nulls = repeat_rows(nulls, "n_null", "i").select(
        *keys, "ds", F.when(F.col("i") < F.col("filled"), F.col("prev_y")).alias("y"), F.lit(True).alias("is_gap")
    )
    return values.unionByName(added).unionByName(nulls)


def _require_min_rows(rows: DataFrame, regular: DataFrame) -> None:
    # regularising never removes rows, so four input rows settle the question
    if rows.limit(MIN_PERIODS).count() < MIN_PERIODS:
        n = regular.limit(MIN_PERIODS).count()
        if n < MIN_PERIODS:
            raise ValueError(
                f"Only {n} row(s) on the calendar: fewer than {MIN_PERIODS} periods cannot be analysed."
            )


def load_sales(
    path,
    date_col: str = "date",
    value_col: str = "amount",
    segment_col: str | None = None,
    freq: str | None = None,
    keys: list[str] = (),
    max_fill: int = 3,
    strict_gaps: bool = False,
    validate: bool = True,
    date_format: str | None = None,
    format: str | None = None,
) -> SalesFrame:
    """Read a table (path of a `format`, or DataFrame) and regularise it.  A
    `segment_col` that the data does not have is ignored."""
    table = read_table(path, format=format)
    keys = list(keys)
    segment = segment_col if segment_col and segment_col in table.columns else None
    group = [*keys, *([segment] if segment else [])]
    rows = typed_rows(table, date_col, value_col, group, validate, date_format)
    resolved = resolve_freq(rows, freq)
    regular = regularise(rows, resolved, group, max_fill, strict_gaps)
    if validate and not keys:
        _require_min_rows(rows, regular)
    return SalesFrame(regular, resolved, tuple(keys), segment)


def to_series(
    table,
    date_col: str,
    value_col: str,
    keys: list[str] = (),
    freq: str = "D",
    agg: str = "sum",
    segment_col: str | None = None,
    fill: bool = True,
    max_fill: int = 3,
    strict_gaps: bool = False,
    format: str | None = None,
    drop_partial: bool = False,
) -> SalesFrame:
    """Transactions to one row per (keys, segment, period).

    This is the step to take before ordered operators on big tables: it is one
    map-side combined aggregate, and afterwards the length of a series is bounded
    by the calendar, whatever share of the rows its key holds.  `drop_partial`
    leaves out the last period of the table unless its dates reach that period's
    last day."""
    freq = "W-MON" if freq == "W" else cal.canonical(freq)
    group = [*keys, *([segment_col] if segment_col else [])]
    rows = typed_rows(read_table(table, format=format), date_col, value_col, group, validate=False)
    rows = rows.dropna(subset=["ds", *group])
    if drop_partial:
        columns, end = rows.columns, F.col("__end")
        start = cal.period_start(end, freq)
        whole = F.date_add(end, 1) >= cal.future_date(start, freq, F.lit(1))
        rows = attach(rows, rows.agg(F.max("ds").alias("__end")), [], ["__end"])
        rows = rows.where((F.col("ds") < start) | whole).select(*columns)
    rows = rows.withColumn("ds", cal.period_start(F.col("ds"), freq))
    series = rows.groupBy(*group, "ds").agg(_AGGREGATES[agg]("y").cast("double").alias("y"))
    if fill:
        df = regularise(series, freq, group, max_fill, strict_gaps, one_row_per_date=True, unique=True)
    else:
        df = series.withColumn("is_gap", F.isnull("y"))
    return SalesFrame(df, freq, tuple(keys), segment_col, one_row_per_date=True)
