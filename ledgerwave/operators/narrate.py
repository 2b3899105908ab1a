"""Findings as text rows `(keys…, ds, text)`.

A finding is a row, not one long string per series: the headline has no date,
each anomaly is a row of its own.  So a series with very many anomalies is never
gathered anywhere.  `ORDER BY keys, ds NULLS FIRST` is reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import (
    NO_FINDINGS, AnomalyTable, CohortTable, Decomposition, Forecast, GrowthMetrics, SegmentRanking,
)
from ..functions.ordering import attach
from ..functions.text import fixed, percent


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _int(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def _lines(df: DataFrame, keys, text: Column) -> DataFrame:
    return df.select(*keys, F.lit(None).cast("date").alias("ds"), text.alias("text"))


def _sign_word(x: Column, up: str, down: str) -> Column:
    return F.when(x > 0, F.lit(up)).when(x < 0, F.lit(down)).otherwise(F.lit("flat"))


def narrate_anomalies(at: AnomalyTable) -> DataFrame:
    keys = list(at.keys)
    counts = at.anomalies.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    if keys:
        counts = at.series.select(*keys).join(counts, keys, "left").fillna(0, ["found"])
    n = F.col("found")
    head = F.when(n == 0, F.lit(f"{NO_FINDINGS} No anomalies detected in this period.")).otherwise(
        _say("Found ", _int(n), " anomalous period", F.when(n > 1, F.lit("s")).otherwise(F.lit("")), ":")
    )
    each = at.anomalies.select(
        *keys, "ds",
        _say("  • ", F.date_format("ds", "yyyy-MM-dd"), ": ", F.col("label"), " (value=", fixed(F.col("y"), 1), ")").alias("text"),
    )
    return _lines(counts, keys, head).unionByName(each)


def narrate_growth(gm: GrowthMetrics) -> DataFrame:
    keys = list(gm.keys)
    marks = gm.rolling.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_inflection").alias("turns")
    )
    if keys:
        d = gm.summary.join(marks, keys, "left").fillna(0, ["points", "turns"])
    else:
        d = attach(gm.summary, marks, keys, ["points", "turns"])
    text = F.when(
        F.col("cagr").isNull(), F.lit(f"{NO_FINDINGS} Could not compute growth rate.")
    ).otherwise(_say(
        "Overall trend: ", _sign_word(F.col("cagr"), "upward", "downward"),
        " — compound annual growth rate of ", percent(F.col("cagr")), ". Rolling ", str(gm.window),
        "-period growth tracked ", _int(F.col("points")), " data points. Found ", _int(F.col("turns")),
        " inflection point(s).",
    ))
    return _lines(d, keys, text)


def narrate_segments(sr: SegmentRanking) -> DataFrame:
    keys = list(sr.keys)
    row = F.struct("segment", "cagr", "trend_direction")
    ends = sr.summary.groupBy(*keys).agg(
        F.min_by(row, sr.order).alias("top"), F.max_by(row, sr.order).alias("bottom")
    )

    def describe(c: str) -> Column:
        rate = F.coalesce(percent(F.col(f"{c}.cagr")), F.lit("nan%"))
        return _say(F.col(f"{c}.segment").cast("string"), " (CAGR ", rate, ", trend: ", F.col(f"{c}.trend_direction"), ").")

    text = F.when(F.col("top").isNull(), F.lit(f"{NO_FINDINGS} No segments found.")).otherwise(
        _say("Top performer: ", describe("top"), " Bottom performer: ", describe("bottom"))
    )
    return _lines(ends, keys, text)


def narrate_decomposition(dr: Decomposition) -> DataFrame:
    keys = list(dr.keys)
    order = F.struct("ds", "y")
    ends = dr.components.groupBy(*keys).agg(
        (F.max_by("trend", order) - F.min_by("trend", order)).alias("rise"),
        F.coalesce(F.stddev_samp("seasonal"), F.lit(0.0)).alias("strength"),
    )
    text = _say(
        "Underlying trend: ", _sign_word(F.col("rise"), "upward", "downward"),
        " over the full period. Seasonal component strength (std): ", fixed(F.col("strength"), 2),
        f". Decomposition period: {dr.period}.",
    )
    return _lines(ends, keys, text)


def narrate_forecast(fr: Forecast) -> DataFrame:
    keys = list(fr.keys)
    ends = fr.forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("yhat", "step").alias("a"), F.max_by("yhat", "step").alias("b")
    )
    text = _say(
        "Forecast: ", _int(F.col("n")), " period(s) ahead. Projected range: ",
        F.coalesce(fixed(F.col("a"), 1), F.lit("nan")), " → ", F.coalesce(fixed(F.col("b"), 1), F.lit("nan")),
        " (", _sign_word(F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)), "growing", "declining"),
        "). 80% confidence interval included.",
    )
    return _lines(ends, keys, text)


def narrate_cohort(ct: CohortTable) -> DataFrame:
    """The zero-filled table has every offset for every cohort, so the second
    column of the matrix is the second smallest offset."""
    keys = list(ct.keys)
    by_offset = ct.retention.groupBy(*keys, "period_offset").agg(
        F.avg("retention").alias("avg"), F.count(F.lit(1)).alias("cohorts")
    )
    d = by_offset.groupBy(*keys).agg(
        F.max("cohorts").alias("cohorts"), F.count(F.lit(1)).alias("periods"),
        F.sort_array(F.collect_list(F.struct("period_offset", "avg"))).alias("o"),
    )
    p1 = F.get("o", F.lit(1))["avg"]
    word = F.when(p1 >= 0.70, F.lit("strong")).when(p1 >= 0.40, F.lit("moderate")).otherwise(F.lit("weak"))
    head = ("Cohort analysis: ", _int(F.col("cohorts")), " cohort(s)")
    text = (
        F.when(F.coalesce(F.col("periods"), F.lit(0)) == 0, F.lit(f"{NO_FINDINGS} Cohort table is empty."))
        .when(F.col("periods") >= 2, _say(
            *head, " over up to ", _int(F.col("periods")), " period(s). Average period-1 retention: ",
            percent(p1, 0), " (", word, ")."))
        .otherwise(_say(*head, ", only baseline period available."))
    )
    return _lines(d, keys, text)


_BY_TYPE = {
    AnomalyTable: narrate_anomalies,
    GrowthMetrics: narrate_growth,
    SegmentRanking: narrate_segments,
    Decomposition: narrate_decomposition,
    Forecast: narrate_forecast,
    CohortTable: narrate_cohort,
}


def narrate(result) -> DataFrame:
    """Findings of any operator result; other values give a plain "nothing" row."""
    for kind, speak in _BY_TYPE.items():
        if isinstance(result, kind):
            return speak(result)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return _lines(spark.range(1), [], F.lit(NO_FINDINGS))
