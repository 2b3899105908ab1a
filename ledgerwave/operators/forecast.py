"""Holt-Winters forecasts with an 80 % band, one model per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import Forecast, SalesFrame
from ..functions import calendar as cal
from ..functions.ordering import one_per_date, spread, with_stats
from .smoothing import fit

MIN_POINTS = 4
Z80 = 1.28


def _fitted(obs: DataFrame, keys: list[str], horizon: int, period: int) -> DataFrame:
    """Holt-Winters with fitted parameters; seasonal only with two full cycles."""
    points = obs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("p"))
    n = F.size("p")
    season = F.when(n >= 2 * period, period).otherwise(1) if period > 1 else F.lit(1)
    series = points.select(*keys, F.transform("p", lambda r: r["y"]).alias("y"), n.alias("n"), season.alias("m"),
                           F.element_at("p", -1)["ds"].alias("last_ds"))
    variance = (F.col("state.s2") - F.col("state.s1") * F.col("state.s1") / F.col("n")) / (F.col("n") - 1)
    ahead = fit(spread(series, keys)).select(
        *keys, "last_ds", "m", "state", F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    turn = F.element_at("state.ring", ((F.col("step") - 1) % F.col("m") + 1).cast("int"))
    return ahead.withColumn("yhat", F.col("state.l") + F.col("state.b") * F.col("step") + turn)


def _fixed(obs: DataFrame, keys: list[str], horizon: int, alpha: float, beta: float) -> DataFrame:
    """Holt's linear method with given smoothing: a fold over the sorted series."""
    d = F.lit(0.0)
    points = obs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("p"))
    start = F.struct(
        F.col("p")[0]["y"].alias("l"), (F.col("p")[1]["y"] - F.col("p")[0]["y"]).alias("b"),
        d.alias("s1"), d.alias("s2"),
    )

    def advance(s, row):
        e = row["y"] - (s["l"] + s["b"])
        return F.struct(
            (s["l"] + s["b"] + alpha * e).alias("l"), (s["b"] + alpha * beta * e).alias("b"),
            (s["s1"] + e).alias("s1"), (s["s2"] + e * e).alias("s2"),
        )

    n = F.size("p") - 1
    s = points.select(
        *keys,
        F.aggregate(F.slice("p", 2, n), start, advance).alias("s"),
        F.col("p")[n]["ds"].alias("last_ds"), n.alias("n"),
    )
    variance = (F.col("s.s2") - F.col("s.s1") * F.col("s.s1") / F.col("n")) / (F.col("n") - 1)
    return s.select(
        *keys, "last_ds", "s", F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
    ).withColumn("yhat", F.col("s.l") + F.col("s.b") * F.col("step"))


def forecast(
    sf: SalesFrame, horizon: int = 12, smoothing: tuple[float, float] | None = None, duplicates: str = "sum"
) -> Forecast:
    """`horizon` future periods on the series grid.  Series with fewer than four
    values are listed in `rejected`; with a single series that is an error.
    `smoothing=(level, slope)` fixes the parameters and skips the seasonal part.
    Rows that share a date count as one, the `duplicates` "sum" or "mean" of them."""
    keys = list(sf.keys)
    obs = sf.observed()
    if not sf.calendar_bounded:
        obs = one_per_date(obs, keys, duplicates)
    if not keys and obs.limit(MIN_POINTS).count() < MIN_POINTS:
        raise ValueError(f"A forecast takes at least {MIN_POINTS} values, the series has {obs.count()}.")
    sizes = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rejected = sizes.where(F.col("n") < MIN_POINTS).withColumn(
        "reason", F.concat(F.lit(f"needs at least {MIN_POINTS} observations, got "), F.col("n").cast("string"))
    )
    enough = obs
    if keys:
        sized = with_stats(obs, keys, [], {"n": F.count(F.lit(1))}, True)
        enough = sized.where(F.col("n") >= MIN_POINTS).drop("n")
    if smoothing:
        fit = _fixed(enough, keys, horizon, *smoothing)
    else:
        fit = _fitted(enough, keys, horizon, cal.seasonal_period(sf.freq, default=1))
    band = Z80 * F.col("sd")
    out = fit.select(
        *keys, "step",
        cal.future_date(F.col("last_ds"), sf.freq, F.col("step")).alias("ds"),
        "yhat", (F.col("yhat") - band).alias("lower"), (F.col("yhat") + band).alias("upper"),
    )
    return Forecast(out, rejected, horizon, tuple(keys))
