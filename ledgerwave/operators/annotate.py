"""Series with trend overlay and anomaly marks: the data behind a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import AnomalyTable, Decomposition, SalesFrame


def _by_date(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    return df.groupBy(*keys, "ds").agg(*aggs)


def plot_annotated(
    sf: SalesFrame, anomalies: AnomalyTable | None = None, trend: Decomposition | None = None,
    title: str | None = None,
) -> DataFrame:
    """`(keys…, ds, y, is_gap, trend, is_anomaly, label)`, and a caption column
    `title` if one is given; every row of the series stays.  Joins are on keys and date, so a long series is spread by date."""
    keys = list(sf.keys)
    on = [*keys, "ds"]
    out = sf.df.select(*keys, *([sf.segment_col] if sf.segment_col else []), "ds", "y", "is_gap")
    if trend is not None:
        # several rows of a date share one overlay value
        line = _by_date(trend.components, keys, F.avg("trend").alias("trend"))
        out = out.join(line, on, "left")
    else:
        out = out.withColumn("trend", F.lit(None).cast("double"))
    if anomalies is not None:
        marks = anomalies.anomalies.select(*on, "y", "label").groupBy(*on, "y").agg(F.first("label").alias("label"))
        out = out.join(marks, [*on, "y"], "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    first = [*keys, *([sf.segment_col] if sf.segment_col else []), "ds", "y", "is_gap", "trend"]
    caption = [F.lit(title).alias("title")] if title else []
    return out.select(*first, F.col("label").isNotNull().alias("is_anomaly"), "label", *caption)
