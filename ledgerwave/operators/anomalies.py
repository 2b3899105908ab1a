"""Anomaly detection: z-score, interquartile range, like-with-like buckets and
isolation forest.  Every method is row-wise, so duplicates per date are fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import AnomalyTable, SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import attach, attach_spread, quantiles, repeat_rows, with_stats
from ..functions.text import fixed
from .forest import forest_scores

METHODS = ("auto", "zscore", "iqr", "iforest", "contextual")
DEFAULT_THRESHOLD = {"zscore": 3.0, "iqr": 1.5, "contextual": 2.5, "iforest": 0.05}


def label(score: Column, direction: Column) -> Column:
    side = F.when(direction > 0, F.lit("above")).otherwise(F.lit("below"))
    return F.concat(fixed(F.abs(score), 1), F.lit("σ "), side, F.lit(" expected"))


def _table(df: DataFrame, keys: list[str], method: str, threshold: float, direction: Column) -> DataFrame:
    return df.select(
        *keys, "ds", "y", "score",
        F.lit(method).alias("method"),
        label(F.col("score"), direction).alias("label"),
        F.lit(float(threshold)).alias("threshold"),
    )


def _mean_sd() -> dict[str, Column]:
    return {"mean": F.avg("y"), "sd": F.stddev_samp("y")}


def _zscores(obs: DataFrame, keys: list[str], by: list[str], threshold: float, bounded: bool) -> DataFrame:
    d = with_stats(obs, keys, by, _mean_sd(), bounded)
    d = d.where("sd > 0").withColumn("score", (F.col("y") - F.col("mean")) / F.col("sd"))
    return d.where(F.abs("score") > threshold)


def _iqr(obs: DataFrame, keys: list[str], threshold: float, bounded: bool) -> DataFrame:
    if bounded:
        q = F.percentile("y", F.array(F.lit(0.25), F.lit(0.75)))
        d = with_stats(obs, keys, [], {"q": q, "mean": F.avg("y")}, True)
        q1, q3 = F.col("q")[0], F.col("q")[1]
    else:
        cuts = quantiles(obs, keys, [0.25, 0.75], False)
        if keys:
            cuts = attach(cuts, obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys, ["__rows"])
        d = attach_spread(obs, cuts, keys, ["q0", "q1", "mean"], "__rows")
        q1, q3 = F.col("q0"), F.col("q1")
    iqr = q3 - q1
    d = d.where((F.col("y") < q1 - threshold * iqr) | (F.col("y") > q3 + threshold * iqr))
    return d.withColumn("score", (F.col("y") - F.col("mean")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr))


def detect_anomalies(sf: SalesFrame, method: str = "auto", threshold: float | None = None) -> AnomalyTable:
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method!r}")
    keys, bounded = list(sf.keys), sf.calendar_bounded
    if method == "auto":
        method = "contextual" if cal.is_sub_monthly(sf.freq) and sf.segment_col is None else "zscore"
    t = DEFAULT_THRESHOLD[method] if threshold is None or method == "iforest" else float(threshold)
    obs = sf.observed()
    mean_side = F.when(F.col("y") > F.col("mean"), F.lit(1)).otherwise(F.lit(-1))
    if method == "zscore":
        found = _table(_zscores(obs, keys, [], t, bounded), keys, method, t, F.col("score"))
    elif method == "contextual":
        bucket = F.weekday("ds") if cal.is_sub_monthly(sf.freq) else F.month("ds")
        d = _zscores(obs.withColumn("bucket", bucket), keys, ["bucket"], t, bounded)
        found = _table(d, keys, method, t, F.col("score"))
    elif method == "iqr":
        found = _table(_iqr(obs, keys, t, bounded), keys, method, t, mean_side)
    else:
        d = repeat_rows(forest_scores(obs, keys, bounded).where("score > cut"), "n", "__i")
        found = _table(d, keys, method, t, mean_side)
    series = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return AnomalyTable(found, method, t, series, tuple(keys))
