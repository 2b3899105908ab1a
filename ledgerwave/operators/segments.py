"""Segment ranking by growth or latest value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..core import SalesFrame, SegmentRanking
from ..functions import calendar as cal
from ..functions.ordering import attach, name_numbers, part_of, positions, rank_rows, sketch
from .growth import compound_growth

FLAT_BAND = 0.01  # slope within ±1 % of the mean counts as flat


def compare_segments(sf: SalesFrame, by: str | None = None, ranked_by: str = "cagr") -> SegmentRanking:
    seg = by or sf.segment_col
    if not seg:
        raise ValueError("compare_segments needs a segment column: name it in `by` or load with `segment_col`")
    if seg not in sf.df.columns:
        raise ValueError(f"no column '{seg}' to compare, only {sf.df.columns}")
    if ranked_by not in ("cagr", "latest_value"):
        raise ValueError(f"ranked_by must be 'cagr' or 'latest_value', not {ranked_by!r}")
    keys = list(sf.keys)
    group = [*keys, seg] if seg not in keys else keys
    bounded = sf.one_row_per_date and set(group) >= set(sf.group_keys)
    obs = sf.df.where("y IS NOT NULL").dropna(subset=[seg]).select(*group, "ds", "y")

    # everything about a segment in one map-side combined aggregate of numbers, which need not sort; the slope sees the
    # second half only
    placed = positions(obs, group, bounded, size="__total")
    late, y = F.col("pos") >= F.expr("__total div 2"), F.col("y")
    s = placed.groupBy(*group).agg(
        F.min_by("y", "pos").alias("first_y"), F.max_by("y", "pos").alias("last_y"), F.count("y").alias("n"),
        F.count_if(late).alias("n_late"), F.avg(F.when(late, y)).alias("mean"),
        F.regr_slope(F.when(late, y), F.when(late, F.col("pos"))).alias("slope"),
    ).where("n >= 2")
    limit, two = F.col("mean") * FLAT_BAND, F.col("n_late") >= 2
    keys = [k for k in keys if k != seg]
    summary = s.select(
        *keys,
        F.col(seg).alias("segment"),
        compound_growth(
            F.col("first_y"), F.col("last_y"), F.col("n"), cal.periods_per_year(sf.freq), 0.0
        ).alias("cagr"),
        F.col("last_y").alias("latest_value"),
        F.when(two & (F.col("slope") > limit), F.lit("up"))
        .when(two & (F.col("slope") < -limit), F.lit("down"))
        .otherwise(F.lit("flat")).alias("trend_direction"),
    )
    return SegmentRanking(summary, ranked_by, tuple(keys))


def ranked(sr: SegmentRanking) -> DataFrame:
    """The summary with a 1-based `rank` column.

    There may be very many segments, also with one and the same metric.  Blocks of metric values come from a sketch of
    them; the value at the upper edge of a block, which may be a very frequent one, is parted by names, in blocks that
    come from a sketch of the names.  Segments without a metric are parted by names as well."""
    keys, metric = list(sr.keys), F.col(sr.ranked_by)
    kind = sr.summary.schema["segment"].dataType
    d = sr.summary.withColumns({"__down": -metric, "__none": F.isnull(metric)})
    if isinstance(kind, T.StringType):
        d = name_numbers(d, keys, "segment", "__name")
    else:
        number = F.col("segment") if isinstance(kind, T.NumericType) else F.unix_date(F.col("segment").cast("date"))
        d = d.withColumn("__name", number.cast("double"))
    edges = d.groupBy(*keys).agg(sketch("__down").alias("__values"), sketch("__name").alias("__names"))
    d = attach(d, edges, keys, ["__values", "__names"])
    block = part_of(F.col("__down"), F.col("__values"))
    frequent = F.col("__none") | F.coalesce(F.get("__values", block.cast("int")) == F.col("__down"), F.lit(False))
    names = F.when(frequent, part_of(F.col("__name"), F.col("__names"))).otherwise(F.lit(0).cast("bigint"))
    d = d.withColumns({"__block": F.when(F.col("__none"), 0).otherwise(block), "__frequent": frequent, "__part": names})
    placed = rank_rows(d, keys, ["__none", "__block", "__frequent", "__part"], ["__down", "segment"], out="rank")
    return placed.select(*sr.summary.columns, (F.col("rank") + 1).alias("rank"))
