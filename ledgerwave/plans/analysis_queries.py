"""Growth, trend, anomaly, segment, forecast, cohort and narration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import SalesFrame
from ..operators.annotate import plot_annotated
from ..operators.anomalies import detect_anomalies
from ..operators.cohort import cohort_analysis, retention_matrix
from ..operators.forecast import forecast
from ..operators.growth import growth_metrics
from ..operators.narrate import narrate
from ..operators.segments import compare_segments, ranked
from ..operators.series import to_series
from ..operators.trend import decompose_trend
from ..sources.tables import typed_rows
from . import sqltext as sql
from .registry import query, table
from .series_queries import ORDERS, PRIORITY, orders_series

MONTHLY = sql.prepared(*ORDERS, "sum(o_totalprice)", PRIORITY, "MS")
DAILY = sql.prepared(*ORDERS, "sum(o_totalprice)")
PART_MONTHLY = sql.prepared("lineitem", "l_shipdate", "sum(l_quantity)", ["l_partkey"], "MS")
QTY_MONTHLY = sql.prepared("lineitem", "l_shipdate", "sum(l_quantity)", ["l_returnflag"], "MS")


def monthly(spark, folder):
    return orders_series(spark, folder, keys=PRIORITY, freq="M")


def daily(spark, folder):
    return orders_series(spark, folder)


def part_monthly(spark, folder):
    return to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_partkey"], freq="M")


def quantity_monthly(spark, folder):
    return to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_returnflag"], freq="M")


def lineitem_rows(spark, folder, keys=(), segment=None, value="l_extendedprice"):
    """Unaggregated rows as a frame: many rows share a date."""
    group = [*keys, *([segment] if segment else [])]
    rows = typed_rows(table(spark, folder, "lineitem"), "l_shipdate", value, group)
    return SalesFrame(rows.withColumn("is_gap", F.isnull("y")), "D", tuple(keys), segment)


# --- growth -------------------------------------------------------------------

_GROWTH = """p AS (SELECT *, lag(y, {w}) OVER ({part}ORDER BY ds, y) AS prev FROM {src} WHERE y IS NOT NULL),
q AS (SELECT *, CASE WHEN prev <> 0 THEN y / prev - 1 WHEN prev = 0 AND y > 0 THEN 'inf'::DOUBLE WHEN prev = 0 AND y < 0 THEN '-inf'::DOUBLE END AS growth FROM p),
h AS (SELECT *, lag(growth) OVER ({part}ORDER BY ds, y) AS before FROM q WHERE growth IS NOT NULL)"""


@query(f"""WITH {MONTHLY}, {_GROWTH.format(w=4, part='PARTITION BY o_orderpriority ', src='f')}
SELECT o_orderpriority, ds, round(growth, 4) AS growth, coalesce(growth * before < 0, false) AS is_inflection FROM h""")
def rolling_growth(spark, folder):
    g = growth_metrics(monthly(spark, folder)).rolling
    return g.withColumn("growth", F.round("growth", 4))


@query(f"""WITH {PART_MONTHLY}, {_GROWTH.format(w=4, part='PARTITION BY l_partkey ', src='f')}
SELECT l_partkey, count(*) AS points, count(*) FILTER (WHERE growth * before < 0) AS turns,
  round(avg(growth), 4) AS mean_growth FROM h GROUP BY 1""")
def growth_many_series(spark, folder):
    g = growth_metrics(part_monthly(spark, folder)).rolling
    return g.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_inflection").alias("turns"),
        F.round(F.avg("growth"), 4).alias("mean_growth"),
    )


# Quantities are small whole numbers, so equal rows and exact repeats abound.
@query(f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_quantity AS y FROM lineitem),
{_GROWTH.format(w=4, part='', src='s')}
SELECT ds, count(*) AS points, count(*) FILTER (WHERE growth * before < 0) AS turns, round(sum(growth), 4) AS total FROM h GROUP BY 1""")
def growth_over_rows(spark, folder):
    g = growth_metrics(lineitem_rows(spark, folder, value="l_quantity")).rolling
    return g.groupBy("ds").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_inflection").alias("turns"),
        F.round(F.sum("growth"), 4).alias("total"),
    )


# The window is longer than a block of positions.
@query(f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_quantity AS y FROM lineitem),
{_GROWTH.format(w=55_000, part='', src='s')}
SELECT ds, count(*) AS points, count(*) FILTER (WHERE growth * before < 0) AS turns, round(sum(growth), 4) AS total FROM h GROUP BY 1""")
def growth_long_window(spark, folder):
    g = growth_metrics(lineitem_rows(spark, folder, value="l_quantity"), window=55_000).rolling
    return g.groupBy("ds").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_inflection").alias("turns"),
        F.round(F.sum("growth"), 4).alias("total"),
    )


_CAGR = """c AS (SELECT {k}first(y ORDER BY ds, y) AS a, last(y ORDER BY ds, y) AS z, count(*) AS n FROM {src} WHERE y IS NOT NULL {g})"""


@query(f"""WITH {MONTHLY}, {_CAGR.format(k='o_orderpriority, ', src='f', g='GROUP BY 1')}
SELECT o_orderpriority, CASE WHEN n >= 2 AND a > 0 THEN round(pow(z / a, 1 / greatest(n / 12.0, 0.01)) - 1, 4) END AS cagr, n AS n_points FROM c""")
def cagr(spark, folder):
    return growth_metrics(monthly(spark, folder)).summary.withColumn("cagr", F.round("cagr", 4))


@query(f"""WITH {MONTHLY}, {_GROWTH.format(w=1, part='PARTITION BY o_orderpriority ', src='f')}
SELECT o_orderpriority, ds FROM h WHERE growth * before < 0""")
def inflection_points(spark, folder):
    return growth_metrics(monthly(spark, folder), window=1).inflection_points


# --- trend --------------------------------------------------------------------

@query(f"""WITH {sql.prepared('events', 'ts', 'sum(value)', ['event_type'])},
t AS (SELECT *, avg(y) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 13 PRECEDING AND 12 FOLLOWING) AS trend FROM f WHERE y IS NOT NULL)
SELECT event_type, ds, round(y, 2) AS y, round(trend, 4) AS trend, 0.0::DOUBLE AS seasonal, round(y - trend, 4) AS residual FROM t""")
def trend_only(spark, folder):
    sf = to_series(table(spark, folder, "events"), "ts", "value", keys=["event_type"])
    d = decompose_trend(sf, period=52).components
    return d.select("event_type", "ds", F.round("y", 2).alias("y"), F.round("trend", 4).alias("trend"), "seasonal",
                    F.round("residual", 4).alias("residual"))


@query("""WITH s AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y FROM lineitem),
t AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag ORDER BY ds, y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS trend FROM s)
SELECT l_returnflag, ds, count(*) AS n, round(sum(trend), 2) AS trend, round(sum(abs(y - trend)), 2) AS residual FROM t GROUP BY 1, 2""")
def trend_over_rows(spark, folder):
    d = decompose_trend(lineitem_rows(spark, folder, ["l_returnflag"]), period=1).components
    return d.groupBy("l_returnflag", "ds").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("trend"), 2).alias("trend"),
        F.round(F.sum(F.abs("residual")), 2).alias("residual"),
    )


@query(f"""WITH RECURSIVE {MONTHLY}, {sql.stl(PRIORITY, 'f', 12)}
SELECT o_orderpriority, ds, round(y, 2) AS y, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(residual, 2) AS residual FROM parts""")
def stl_monthly(spark, folder):
    d = decompose_trend(monthly(spark, folder)).components
    return d.select("o_orderpriority", "ds", *[F.round(c, 2).alias(c) for c in ("y", "trend", "seasonal", "residual")])


SUPPLIER_MONTHLY = sql.prepared("lineitem", "l_shipdate", "sum(l_quantity)", ["l_suppkey"], "MS")


def supplier_monthly(spark, folder):
    return to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_suppkey"], freq="M")


# What trend and season explain, point by point, for every supplier.
@query(f"""WITH RECURSIVE {SUPPLIER_MONTHLY}, {sql.stl(['l_suppkey'], 'f', 12)}
SELECT l_suppkey, ds, y, round(trend + seasonal, 4) AS recomposed FROM parts""")
def stl_recomposed(spark, folder):
    d = decompose_trend(supplier_monthly(spark, folder)).components
    return d.select("l_suppkey", "ds", "y", F.round(F.col("trend") + F.col("seasonal"), 4).alias("recomposed"))


@query(f"""WITH RECURSIVE {SUPPLIER_MONTHLY}, {sql.stl(['l_suppkey'], 'f', 12)}
SELECT l_suppkey, count(*) AS n, round(stddev_samp(seasonal), 2) AS seasonal_sd,
  round(last(trend ORDER BY ds) - first(trend ORDER BY ds), 2) AS rise FROM parts GROUP BY 1""")
def stl_many_series(spark, folder):
    d = decompose_trend(supplier_monthly(spark, folder)).components
    return d.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("seasonal"), 2).alias("seasonal_sd"),
        F.round(F.max_by("trend", "ds") - F.min_by("trend", "ds"), 2).alias("rise"),
    )


# --- anomalies ----------------------------------------------------------------

def _found(at, *keys):
    return at.anomalies.select(*keys, "ds", F.round("y", 2).alias("y"), F.round("score", 4).alias("score"), "method", "label", "threshold")


def _found_sql(keys: str, method: str, direction: str, threshold: float) -> str:
    return (
        f"SELECT {keys}ds, round(y, 2) AS y, round(score, 4) AS score, '{method}' AS method, "
        f"{sql.label('score', direction)} AS label, {threshold}::DOUBLE AS threshold"
    )


@query(f"""WITH {DAILY}, m AS (SELECT avg(y) AS mean, stddev_samp(y) AS sd FROM f),
z AS (SELECT ds, y, (y - mean) / sd AS score FROM f, m WHERE y IS NOT NULL AND sd > 0)
{_found_sql('', 'zscore', 'score', 3.0)} FROM z WHERE abs(score) > 3""")
def anomaly_zscore(spark, folder):
    return _found(detect_anomalies(daily(spark, folder), "zscore"))


@query(f"""WITH {PART_MONTHLY}, z AS (SELECT l_partkey, ds, y, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score
  FROM f WHERE y IS NOT NULL WINDOW w AS (PARTITION BY l_partkey))
{_found_sql('l_partkey, ', 'zscore', 'score', 2.0)} FROM z WHERE abs(score) > 2""")
def anomaly_zscore_many_series(spark, folder):
    return _found(detect_anomalies(part_monthly(spark, folder), "zscore", 2.0), "l_partkey")


@query(f"""WITH z AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y,
  (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w AS score FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))
{_found_sql('l_returnflag, ', 'zscore', 'score', 1.5)} FROM z WHERE abs(score) > 1.5""")
def anomaly_zscore_over_rows(spark, folder):
    return _found(detect_anomalies(lineitem_rows(spark, folder, ["l_returnflag"]), "zscore", 1.5), "l_returnflag")


_IQR = """q AS (SELECT {g}quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, avg(y) AS mean FROM {src} WHERE y IS NOT NULL {by}),
z AS (SELECT {src}.*, (y - mean) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END AS score, CASE WHEN y > mean THEN 1 ELSE -1 END AS side
  FROM {src} {join} WHERE y < q1 - {t} * (q3 - q1) OR y > q3 + {t} * (q3 - q1))"""


@query(f"""WITH {DAILY}, {_IQR.format(g='', src='f', by='', join=', q', t=1.5)}
{_found_sql('', 'iqr', 'side', 1.5)} FROM z""")
def anomaly_iqr(spark, folder):
    return _found(detect_anomalies(daily(spark, folder), "iqr"))


@query(f"""WITH {PART_MONTHLY}, {_IQR.format(g='l_partkey, ', src='f', by='GROUP BY 1', join='JOIN q USING (l_partkey)', t=1.5)}
{_found_sql('l_partkey, ', 'iqr', 'side', 1.5)} FROM z""")
def anomaly_iqr_many_series(spark, folder):
    return _found(detect_anomalies(part_monthly(spark, folder), "iqr"), "l_partkey")


@query(f"""WITH s AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y FROM lineitem),
{_IQR.format(g='l_returnflag, ', src='s', by='GROUP BY 1', join='JOIN q USING (l_returnflag)', t=0.4)}
{_found_sql('l_returnflag, ', 'iqr', 'side', 0.4)} FROM z""")
def anomaly_iqr_over_rows(spark, folder):
    return _found(detect_anomalies(lineitem_rows(spark, folder, ["l_returnflag"]), "iqr", 0.4), "l_returnflag")


_CONTEXT = """z AS (SELECT *, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score FROM {src} WHERE y IS NOT NULL
  WINDOW w AS (PARTITION BY {part}))"""


@query(f"""WITH {DAILY}, {_CONTEXT.format(src='f', part='isodow(ds)')}
{_found_sql('', 'contextual', 'score', 2.5)} FROM z WHERE abs(score) > 2.5""")
def anomaly_contextual_weekday(spark, folder):
    return _found(detect_anomalies(daily(spark, folder)))


@query(f"""WITH {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_suppkey'], 'MS')},
{_CONTEXT.format(src='f', part='l_suppkey, month(ds)')}
{_found_sql('l_suppkey, ', 'contextual', 'score', 1.6)} FROM z WHERE abs(score) > 1.6""")
def anomaly_contextual_month(spark, folder):
    sf = to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_suppkey"], freq="M")
    return _found(detect_anomalies(sf, "contextual", 1.6), "l_suppkey")


@query(f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y FROM lineitem),
{_CONTEXT.format(src='s', part='isodow(ds)')}
{_found_sql('', 'contextual', 'score', 1.65)} FROM z WHERE abs(score) > 1.65""")
def anomaly_contextual_over_rows(spark, folder):
    return _found(detect_anomalies(lineitem_rows(spark, folder), "contextual", 1.65))


@query(f"""WITH {sql.prepared(*ORDERS, "sum(o_totalprice)", PRIORITY)}, {sql.forest(PRIORITY, 'f')}
{_found_sql('o_orderpriority, ', 'iforest', 'side', 0.05)} FROM found""")
def anomaly_iforest(spark, folder):
    return _found(detect_anomalies(orders_series(spark, folder, keys=PRIORITY), "iforest"), "o_orderpriority")


@query(f"""WITH {SUPPLIER_MONTHLY}, {sql.forest(['l_suppkey'], 'f')}
{_found_sql('l_suppkey, ', 'iforest', 'side', 0.05)} FROM found""")
def anomaly_iforest_many_series(spark, folder):
    return _found(detect_anomalies(supplier_monthly(spark, folder), "iforest"), "l_suppkey")


# Far more rows than a forest draws, and many of them equal.
@query(f"""WITH s AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y FROM lineitem), {sql.forest(['l_returnflag'], 's')}
{_found_sql('l_returnflag, ', 'iforest', 'side', 0.05)} FROM found""")
def anomaly_iforest_over_rows(spark, folder):
    return _found(detect_anomalies(lineitem_rows(spark, folder, ["l_returnflag"]), "iforest"), "l_returnflag")


# What share of a series is flagged, and whether its largest value is.
@query(f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_quantity AS y FROM lineitem), {sql.forest([], 's')}
SELECT y, count(*) AS found, round(max(score), 4) AS score FROM found GROUP BY 1""")
def anomaly_iforest_share(spark, folder):
    found = detect_anomalies(lineitem_rows(spark, folder, value="l_quantity"), "iforest").anomalies
    return found.groupBy("y").agg(F.count(F.lit(1)).alias("found"), F.round(F.max("score"), 4).alias("score"))


# --- segments -----------------------------------------------------------------

_RANK = """v AS (SELECT {seg} AS segment, ds, y, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY {seg}) AS n
  FROM {src} WHERE y IS NOT NULL WINDOW w AS (PARTITION BY {seg} ORDER BY ds, y)),
e AS (SELECT segment, first(y ORDER BY ds, y) AS a, last(y ORDER BY ds, y) AS z, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 2),
h AS (SELECT segment, count(*) AS m, regr_slope(y, pos) AS slope, avg(y) AS mean FROM v WHERE pos >= n // 2 GROUP BY 1),
x AS (SELECT segment, CASE WHEN a > 0 THEN pow(z / a, 1 / (n / {ppy})) - 1 END AS cagr, z AS latest_value,
  CASE WHEN m >= 2 AND slope > 0.01 * mean THEN 'up' WHEN m >= 2 AND slope < -0.01 * mean THEN 'down' ELSE 'flat' END AS trend_direction
  FROM e JOIN h USING (segment))
SELECT segment, round(cagr, 4) AS cagr, round(latest_value, 2) AS latest_value, trend_direction,
  row_number() OVER (ORDER BY {by} DESC NULLS LAST, segment) AS rank FROM x"""


def _ranking(sr):
    return ranked(sr).withColumns({"cagr": F.round("cagr", 4), "latest_value": F.round("latest_value", 2)})


@query(f"WITH {MONTHLY}, {_RANK.format(seg='o_orderpriority', src='f', ppy='12.0', by='cagr')}")
def segment_ranking(spark, folder):
    return _ranking(compare_segments(orders_series(spark, folder, segment_col="o_orderpriority", freq="M")))


@query(f"WITH {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_partkey'], 'QS')}, "
       f"{_RANK.format(seg='l_partkey', src='f', ppy='4.0', by='latest_value')}")
def segment_ranking_by_latest(spark, folder):
    sf = to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", segment_col="l_partkey", freq="Q")
    return _ranking(compare_segments(sf, ranked_by="latest_value"))


@query("WITH s AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS ds, l_extendedprice AS y FROM lineitem), "
       + _RANK.format(seg="l_returnflag", src="s", ppy="365.0", by="cagr"))
def segment_ranking_over_rows(spark, folder):
    return _ranking(compare_segments(lineitem_rows(spark, folder, segment="l_returnflag")))


# --- forecast -----------------------------------------------------------------

_HOLT = """o AS (SELECT o_orderpriority AS k, y, ds, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM f WHERE y IS NOT NULL WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ds)),
st AS (SELECT a.k, 1 AS i, a.y AS l, b.y - a.y AS b, NULL::DOUBLE AS e FROM o a JOIN o b ON a.k = b.k AND a.i = 1 AND b.i = 2
  UNION ALL SELECT o.k, o.i, st.l + st.b + 0.3 * (o.y - st.l - st.b), st.b + 0.3 * 0.1 * (o.y - st.l - st.b), o.y - st.l - st.b
  FROM st JOIN o ON o.k = st.k AND o.i = st.i + 1),
sd AS (SELECT k, stddev_samp(e) AS sd FROM st GROUP BY 1),
fin AS (SELECT st.k, st.l, st.b, sd.sd, o.ds FROM st JOIN o ON st.k = o.k AND st.i = o.i AND o.i = o.n JOIN sd ON sd.k = st.k),
fc AS (SELECT k, CAST(i AS INTEGER) AS step, CAST(ds + to_months(CAST(i AS INTEGER)) AS DATE) AS ds, l + b * i AS yhat, sd FROM fin, range(1, 7) t(i))"""


@query(f"""WITH RECURSIVE {MONTHLY}, {_HOLT}
SELECT k AS o_orderpriority, step, ds, round(yhat, 2) AS yhat, round(yhat - 1.28 * sd, 2) AS lower, round(yhat + 1.28 * sd, 2) AS upper FROM fc""")
def holt_fixed(spark, folder):
    d = forecast(monthly(spark, folder), 6, smoothing=(0.3, 0.1)).forecast
    return d.select("o_orderpriority", "step", "ds", *[F.round(c, 2).alias(c) for c in ("yhat", "lower", "upper")])


def _ahead_sql(keys: list[str], src: str, period: int, horizon: int) -> str:
    return (f"WITH RECURSIVE {src}, {sql.holt_winters(keys, 'f', period, horizon)} SELECT {keys[0]}, step, "
            "CAST(last_ds + to_months(step) AS DATE) AS ds, round(yhat, 2) AS yhat, round(yhat - 1.28 * sd, 2) AS lower, "
            "round(yhat + 1.28 * sd, 2) AS upper FROM ahead")


def _ahead(fc, key):
    return fc.forecast.select(key, "step", "ds", *[F.round(c, 2).alias(c) for c in ("yhat", "lower", "upper")])


@query(_ahead_sql(PRIORITY, MONTHLY, 12, 12))
def forecast_hw(spark, folder):
    return _ahead(forecast(monthly(spark, folder), 12), "o_orderpriority")


# The dates of a forecast, and whether its band has a width.
@query(f"""WITH RECURSIVE {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_partkey'], 'QS')},
{sql.holt_winters(['l_partkey'], 'f', 4, 3)}
SELECT l_partkey, step, CAST(last_ds + to_months(3 * step) AS DATE) AS ds, sd > 1e-6 AS inside FROM ahead""")
def forecast_dates(spark, folder):
    sf = to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_partkey"], freq="Q")
    inside = F.col("upper") - F.col("lower") > 2.56e-6
    return forecast(sf, 3).forecast.select("l_partkey", "step", "ds", inside.alias("inside"))


# Some suppliers have less than two years of sales: their model has no season.
@query(_ahead_sql(["l_suppkey"], sql.prepared("lineitem", "l_shipdate", "sum(l_quantity)", ["l_suppkey"], "MS"), 12, 3))
def forecast_many_series(spark, folder):
    sf = to_series(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_suppkey"], freq="M")
    return _ahead(forecast(sf, 3), "l_suppkey")


@query("""WITH s AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ds FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS n, 'needs at least 4 observations, got ' || count(*) AS reason FROM s GROUP BY 1 HAVING count(*) < 4""")
def forecast_rejected(spark, folder):
    sf = orders_series(spark, folder, keys=["o_custkey"], freq="Q", fill=False)
    return forecast(sf, 2).rejected


# --- cohorts ------------------------------------------------------------------

_COHORT = """m AS (SELECT o_custkey, {period} AS ds, {n} AS n FROM orders GROUP BY 1, 2),
g AS (SELECT greatest(1, CAST(floor(median(gap)) AS BIGINT)) AS gap FROM (SELECT ds - lag(ds) OVER (ORDER BY ds) AS gap FROM (SELECT DISTINCT ds FROM m))),
c AS (SELECT *, min(ds) OVER (PARTITION BY o_custkey) AS cohort_start FROM m),
o AS (SELECT cohort_start, (ds - cohort_start) // gap AS period_offset, n, o_custkey FROM c, g),
a AS (SELECT cohort_start, period_offset, CAST({agg} AS BIGINT) AS active FROM o GROUP BY 1, 2),
z AS (SELECT cohort_start, period_offset FROM (SELECT DISTINCT cohort_start FROM a), (SELECT DISTINCT period_offset FROM a)),
d AS (SELECT z.cohort_start, z.period_offset, coalesce(a.active, 0) AS active, coalesce(b.active, 0) AS cohort_size
  FROM z LEFT JOIN a USING (cohort_start, period_offset) LEFT JOIN a b ON b.cohort_start = z.cohort_start AND b.period_offset = 0),
ret AS (SELECT cohort_start, period_offset, active, cohort_size, least(1.0::DOUBLE, coalesce(active::DOUBLE / nullif(cohort_size, 0), 0)) AS retention FROM d)"""
_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
_QUARTER = "CAST(date_trunc('quarter', o_orderdate) AS DATE)"
_RETENTION_SQL = "SELECT cohort_start, period_offset, active, cohort_size, round(retention, 4) AS retention FROM ret"


def _cohorts(spark, folder, freq, count="rows", rows=False):
    if rows:
        t = table(spark, folder, "orders").select(
            "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "QUARTER").alias("ds"), F.col("o_totalprice").alias("y"),
            F.lit(False).alias("is_gap"),
        )
        return cohort_analysis(SalesFrame(t, freq, (), "o_custkey"), "o_custkey", count)
    sf = orders_series(spark, folder, segment_col="o_custkey", freq=freq, fill=False)
    return cohort_analysis(sf, "o_custkey", count)


@query(f"WITH {_COHORT.format(period=_MONTH, n='1', agg='sum(n)')} {_RETENTION_SQL}")
def cohort_retention(spark, folder):
    return _cohorts(spark, folder, "MS").retention.withColumn("retention", F.round("retention", 4))


@query(f"WITH {_COHORT.format(period=_QUARTER, n='count(*)', agg='sum(n)')} {_RETENTION_SQL}")
def cohort_retention_rows(spark, folder):
    return _cohorts(spark, folder, "QS", rows=True).retention.withColumn("retention", F.round("retention", 4))


@query(f"WITH {_COHORT.format(period=_QUARTER, n='count(*)', agg='count(DISTINCT o_custkey)')} {_RETENTION_SQL}")
def cohort_retention_distinct(spark, folder):
    return _cohorts(spark, folder, "QS", "distinct", rows=True).retention.withColumn("retention", F.round("retention", 4))


_BY_QUARTER = _COHORT.format(period=_QUARTER, n='1', agg='sum(n)').replace(
    "(ds - cohort_start) // gap", "date_diff('quarter', cohort_start, ds)")


@query(f"WITH {_BY_QUARTER} {_RETENTION_SQL}")
def cohort_calendar(spark, folder):
    sf = orders_series(spark, folder, segment_col="o_custkey", freq="QS", fill=False)
    t = cohort_analysis(sf, "o_custkey", offset="calendar").retention
    return t.withColumn("retention", F.round("retention", 4))


# Every offset that the data has is a column.
@query(f"""WITH {_COHORT.format(period=_QUARTER, n='1', agg='sum(n)')}
SELECT * FROM (PIVOT (SELECT cohort_start, period_offset, round(retention, 4) AS retention FROM ret) ON ('p' || period_offset)
USING first(retention) GROUP BY cohort_start)""")
def cohort_matrix(spark, folder):
    wide = retention_matrix(_cohorts(spark, folder, "QS"), prefix="p")
    return wide.select("cohort_start", *[F.round(c, 4).alias(c) for c in wide.columns[1:]])


# Daily cohorts: thousands of offsets, of which a cohort has a few.
@query(f"""WITH {_COHORT.format(period='CAST(o_orderdate AS DATE)', n='1', agg='sum(n)')} {_RETENTION_SQL} WHERE active > 0""")
def cohort_sparse(spark, folder):
    sf = orders_series(spark, folder, segment_col="o_custkey", freq="D", fill=False)
    t = cohort_analysis(sf, "o_custkey", zero_fill=False).retention
    return t.withColumn("retention", F.round("retention", 4))


# --- narration and annotation -------------------------------------------------

@query(f"""WITH {QTY_MONTHLY}, z AS (SELECT l_returnflag, ds, y, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score
  FROM f WHERE y IS NOT NULL WINDOW w AS (PARTITION BY l_returnflag)),
x AS (SELECT *, {sql.label('score', 'score')} AS label FROM z WHERE abs(score) > 2.5),
n AS (SELECT k.l_returnflag, count(x.ds) AS found FROM (SELECT DISTINCT l_returnflag FROM z) k LEFT JOIN x USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, NULL::DATE AS ds, CASE WHEN found = 0 THEN 'No notable findings. No anomalies detected in this period.'
  ELSE 'Found ' || found || ' anomalous period' || CASE WHEN found > 1 THEN 's' ELSE '' END || ':' END AS text FROM n
UNION ALL SELECT l_returnflag, ds, '  • ' || strftime(ds, '%Y-%m-%d') || ': ' || label || ' (value=' || {sql.fixed('y', 1)} || ')' FROM x""")
def narrate_anomalies(spark, folder):
    return narrate(detect_anomalies(quantity_monthly(spark, folder), "zscore", 2.5))


_SIGN = "CASE WHEN {x} > 0 THEN '{up}' WHEN {x} < 0 THEN '{down}' ELSE 'flat' END"


@query(f"""WITH {MONTHLY}, {_GROWTH.format(w=4, part='PARTITION BY o_orderpriority ', src='f')},
{_CAGR.format(k='o_orderpriority, ', src='f', g='GROUP BY 1')},
r2 AS (SELECT o_orderpriority, count(*) AS points, count(*) FILTER (WHERE growth * before < 0) AS turns FROM h GROUP BY 1),
w AS (SELECT o_orderpriority, CASE WHEN n >= 2 AND a > 0 THEN pow(z / a, 1 / greatest(n / 12.0, 0.01)) - 1 END AS cagr, points, turns FROM c JOIN r2 USING (o_orderpriority))
SELECT o_orderpriority, NULL::DATE AS ds, CASE WHEN cagr IS NULL THEN 'No notable findings. Could not compute growth rate.'
ELSE 'Overall trend: ' || {_SIGN.format(x='cagr', up='upward', down='downward')} || ' — compound annual growth rate of ' || {sql.fixed('cagr * 100', 1)} ||
'%. Rolling 4-period growth tracked ' || points || ' data points. Found ' || turns || ' inflection point(s).' END AS text FROM w""")
def narrate_growth(spark, folder):
    return narrate(growth_metrics(monthly(spark, folder)))


@query(f"""WITH {MONTHLY}, rk AS (WITH {_RANK.format(seg='o_orderpriority', src='f', ppy='12.0', by='cagr')}),
t AS (SELECT * FROM rk WHERE rank = 1), u AS (SELECT * FROM rk ORDER BY rank DESC LIMIT 1)
SELECT NULL::DATE AS ds, 'Top performer: ' || t.segment || ' (CAGR ' || {sql.fixed('t.cagr * 100', 1)} || '%, trend: ' || t.trend_direction ||
'). Bottom performer: ' || u.segment || ' (CAGR ' || {sql.fixed('u.cagr * 100', 1)} || '%, trend: ' || u.trend_direction || ').' AS text FROM t, u""")
def narrate_segments(spark, folder):
    return narrate(compare_segments(orders_series(spark, folder, segment_col="o_orderpriority", freq="M")))


@query(f"""WITH RECURSIVE {MONTHLY}, {sql.stl(PRIORITY, 'f', 12)},
e AS (SELECT o_orderpriority, last(trend ORDER BY ds) - first(trend ORDER BY ds) AS rise, stddev_samp(seasonal) AS sd FROM parts GROUP BY 1)
SELECT o_orderpriority, NULL::DATE AS ds, 'Underlying trend: ' || {_SIGN.format(x='rise', up='upward', down='downward')} ||
' over the full period. Seasonal component strength (std): ' || {sql.fixed('sd', 2)} || '. Decomposition period: 12.' AS text FROM e""")
def narrate_seasons(spark, folder):
    return narrate(decompose_trend(monthly(spark, folder)))


@query(f"""WITH {sql.prepared('events', 'ts', 'sum(value)', ['event_type'])},
t AS (SELECT *, avg(y) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 13 PRECEDING AND 12 FOLLOWING) AS trend FROM f WHERE y IS NOT NULL),
e AS (SELECT event_type, last(trend ORDER BY ds) - first(trend ORDER BY ds) AS rise FROM t GROUP BY 1)
SELECT event_type, NULL::DATE AS ds, 'Underlying trend: ' || {_SIGN.format(x='rise', up='upward', down='downward')} ||
' over the full period. Seasonal component strength (std): 0.00. Decomposition period: 52.' AS text FROM e""")
def narrate_decomposition(spark, folder):
    sf = to_series(table(spark, folder, "events"), "ts", "value", keys=["event_type"])
    return narrate(decompose_trend(sf, period=52))


@query(f"""WITH RECURSIVE {MONTHLY}, {_HOLT},
e AS (SELECT k, count(*) AS n, first(yhat ORDER BY step) AS a, last(yhat ORDER BY step) AS b FROM fc GROUP BY 1)
SELECT k AS o_orderpriority, NULL::DATE AS ds, 'Forecast: ' || n || ' period(s) ahead. Projected range: ' || {sql.fixed('a', 1)} || ' → ' || {sql.fixed('b', 1)} ||
' (' || {_SIGN.format(x='(b - a)', up='growing', down='declining')} || '). 80% confidence interval included.' AS text FROM e""")
def narrate_forecast(spark, folder):
    return narrate(forecast(monthly(spark, folder), 6, smoothing=(0.3, 0.1)))


@query(f"""WITH {_COHORT.format(period=_MONTH, n='1', agg='sum(n)')},
p AS (SELECT period_offset, avg(retention) AS r, count(*) AS cohorts, row_number() OVER (ORDER BY period_offset) AS i FROM ret GROUP BY 1),
t AS (SELECT max(cohorts) AS cohorts, count(*) AS periods, max(r) FILTER (WHERE i = 2) AS p1 FROM p)
SELECT NULL::DATE AS ds, 'Cohort analysis: ' || cohorts || ' cohort(s) over up to ' || periods || ' period(s). Average period-1 retention: ' ||
{sql.fixed('p1 * 100', 0)} || '% (' || CASE WHEN p1 >= 0.7 THEN 'strong' WHEN p1 >= 0.4 THEN 'moderate' ELSE 'weak' END || ').' AS text FROM t""")
def narrate_cohort(spark, folder):
    return narrate(_cohorts(spark, folder, "MS"))


@query(f"""WITH {sql.prepared('events', 'ts', 'sum(value)', ['event_type'])},
t AS (SELECT *, avg(y) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN 13 PRECEDING AND 12 FOLLOWING) AS trend,
  (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS score FROM f WHERE y IS NOT NULL WINDOW w AS (PARTITION BY event_type))
SELECT f.event_type, f.ds, round(f.y, 2) AS y, f.is_gap, round(t.trend, 4) AS trend, coalesce(abs(score) > 1.5, false) AS is_anomaly,
  CASE WHEN abs(score) > 1.5 THEN {sql.label('score', 'score')} END AS label
FROM f LEFT JOIN t ON f.event_type = t.event_type AND f.ds = t.ds""")
def annotate_series(spark, folder):
    sf = to_series(table(spark, folder, "events"), "ts", "value", keys=["event_type"])
    d = plot_annotated(sf, detect_anomalies(sf, "zscore", 1.5), decompose_trend(sf, period=52))
    return d.withColumns({"y": F.round("y", 2), "trend": F.round("trend", 4)})
