"""Do the operators find what is claimed about series?

A claim names a series, a kind of signal and, where the kind has one, a date or a segment.  Every operator runs once
over all series that claims ask it about; its findings become one row of facts per series, and each claim is judged by
a boolean expression over the facts of its series.  Claims are rows like others: any number may speak of one series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..core import SalesFrame
from ..functions.stored import stored
from .anomalies import detect_anomalies
from .cohort import cohort_analysis
from .forecast import MIN_POINTS, forecast
from .growth import growth_metrics
from .segments import compare_segments
from .signals import GROWTH, SIGNALS, STRICT_GROWTH
from .trend import decompose_trend

#: Values that a series needs before an operator can run on it.
LEAST_VALUES = 2


def near_dates(dates: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys…, claimed_ds, tolerance) of `dates` with a row of `found` (keys…, ds) of the same key within
    `tolerance` days.

    Days are cut into stretches one longer than the widest tolerance; a date meets the findings of its own stretch and
    of both neighbours.  Both sides hold a date once per key, so a stretch has a bounded number of them, whatever share
    of the rows a date or a key has."""
    widest = max((s.tolerance for s in SIGNALS.values() if s.tolerance is not None), default=0) + 1
    day = {c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) for c in ("claimed_ds", "ds")}
    stretch = F.floor(day["claimed_ds"] / widest)
    asked = dates.where("claimed_ds IS NOT NULL").select(*keys, "claimed_ds", "tolerance").distinct()
    asked = asked.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    seen = found.select(*keys, "ds").distinct().withColumn("stretch", F.floor(day["ds"] / widest))
    met = asked.join(seen, [*keys, "stretch"]).where(F.abs(F.datediff("claimed_ds", "ds")) <= F.col("tolerance"))
    return met.select(*keys, "claimed_ds", "tolerance").distinct()


def _facts(op: str, sf: SalesFrame) -> DataFrame:
    """One row per series: keys…, fact."""
    keys = list(sf.keys)
    if op == "trend":
        rise = F.max_by("trend", "ds") - F.min_by("trend", "ds")
        return decompose_trend(sf).components.groupBy(*keys).agg(rise.alias("fact"))
    if op == "growth":
        return growth_metrics(sf).summary.select(*keys, F.col("cagr").alias("fact"))
    if op.startswith("anomaly_"):
        return detect_anomalies(sf, op.removeprefix("anomaly_")).anomalies.groupBy(*keys).agg(
            F.count(F.lit(1)).cast("double").alias("fact"))
    if op == "segments":
        ranking = compare_segments(sf)
        return ranking.summary.groupBy(*keys).agg(F.max_by("segment", ranking.order).cast("string").alias("fact"))
    if op == "forecast":
        return forecast(sf, 12, smoothing=(0.5, 0.1)).forecast.groupBy(*keys).agg(
            F.count(F.lit(1)).cast("double").alias("fact"))
    rows = cohort_analysis(sf, sf.segment_col).retention
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("fact"))


def _rule(op: str, strict: bool) -> Column:
    """Whether a claim's fact bears it out."""
    fact, rising = F.col("fact"), F.col("signal_type") == "trend_up"
    if op == "trend":
        return F.when(rising, fact > 0).otherwise(fact < 0)
    if op == "growth":
        limit = STRICT_GROWTH if strict else GROWTH
        return F.when(rising, fact > limit).otherwise(fact < -limit)
    if op == "segments":
        return F.upper(fact) == F.upper("claimed_segment")
    return fact > 0


def verify_claims(claims: DataFrame, frames: dict[str, SalesFrame], strict: bool = False) -> DataFrame:
    """The claims, once for each operator of their kind, with `op`, `ran` and `detected`.

    `claims` has the frames' keys, `signal_type`, `claimed_ds` and `claimed_segment` (null where a kind has none), and
    any other columns.  `frames` has a keyed frame for each operator; "anomaly" serves every anomaly method, one with a
    segment column serves "segments" and "cohort".  An operator ran on a series that has the values it needs.
    `strict` asks for a larger growth rate, and for a finding near the claimed date instead of any finding.

    Every operator looks at its frame several times: a frame is computed once and stored.  Claims are read once for
    each operator; claims that take work should be stored by the caller."""
    ops = F.create_map(*[x for t, s in SIGNALS.items() for x in (F.lit(t), F.array(*[F.lit(op) for op in s.ops]))])
    tolerance = F.create_map(*[x for t, s in SIGNALS.items() for x in (F.lit(t), F.lit(s.tolerance).cast("int"))])
    asked = claims.withColumns({"op": F.explode(ops[F.col("signal_type")]), "tolerance": tolerance[F.col("signal_type")]})
    columns = [*claims.columns, "op", "ran", "detected"]
    kept: dict[int, DataFrame] = {}
    parts = [asked.where("op = 'refusal'").withColumns({"ran": F.lit(True), "detected": F.lit(True)}).select(*columns)]
    for op in dict.fromkeys(op for s in SIGNALS.values() for op in s.ops if op != "refusal"):
        frame = frames.get(op) or frames.get(op.partition("_")[0])
        if frame is None:
            continue
        keys = list(frame.keys)
        mine = asked.where(F.col("op") == op)
        if id(frame.df) not in kept:
            kept[id(frame.df)] = stored(frame.df)
        sf = frame.with_df(kept[id(frame.df)].join(mine.select(*keys).distinct(), keys, "left_semi"))
        sizes = sf.observed().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        judged = mine.join(sizes, keys, "left")
        near = strict and op.startswith("anomaly_")
        if near:
            found = detect_anomalies(sf, op.removeprefix("anomaly_")).anomalies
            hits = near_dates(mine, found, keys).withColumn("fact", F.lit(1.0))
            judged = judged.join(hits, [*keys, "claimed_ds", "tolerance"], "left")
        else:
            judged = judged.join(_facts(op, sf), keys, "left")
        least = MIN_POINTS if op == "forecast" else LEAST_VALUES
        ran = F.coalesce(F.col("n") >= least, F.lit(False))
        detected = F.coalesce(F.col("fact") > 0 if near else _rule(op, strict), F.lit(False)) & ran
        parts.append(judged.withColumns({"ran": ran, "detected": detected}).select(*columns))
    return reduce(DataFrame.unionByName, parts)
