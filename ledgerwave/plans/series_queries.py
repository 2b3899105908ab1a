"""Regularisation queries: frequency, calendar, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators.series import infer_freq, load_sales, regularise, to_series
from ..sources.tables import checked_rows, typed_rows
from . import sqltext as sql
from .registry import query, table

PRIORITY = ["o_orderpriority"]
ORDERS = ("orders", "o_orderdate")


def orders_series(spark, folder, **options):
    return to_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", **options)


@query(f"""WITH {sql.prepared(*ORDERS, 'sum(o_totalprice)', PRIORITY)}
SELECT o_orderpriority, ds, round(y, 2) AS y, is_gap FROM f""")
def regularise_daily_by_priority(spark, folder):
    sf = orders_series(spark, folder, keys=PRIORITY)
    return sf.df.select("o_orderpriority", "ds", F.round("y", 2).alias("y"), "is_gap")


@query("""WITH e AS (SELECT max(CAST(o_orderdate AS DATE)) AS e FROM orders)
SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, round(sum(o_totalprice), 2) AS y
FROM orders, e WHERE last_day(e) = e OR o_orderdate < date_trunc('month', e) GROUP BY 1, 2""")
def monthly_drop_partial(spark, folder):
    sf = orders_series(spark, folder, keys=PRIORITY, freq="M", fill=False, drop_partial=True)
    return sf.df.select("o_orderpriority", "ds", F.round("y", 2).alias("y"))


# Rows are not aggregated here: every order stays a row of its segment's series.
@query("""WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y FROM orders),
b AS (SELECT o_orderpriority, min(ds) AS lo, max(ds) AS hi FROM s GROUP BY 1),
g AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM b),
r AS (SELECT o_orderpriority, g.ds, s.y AS y0 FROM g LEFT JOIN s USING (o_orderpriority, ds))
SELECT o_orderpriority, ds, coalesce(y0, last_value(y0 IGNORE NULLS) OVER
  (PARTITION BY o_orderpriority ORDER BY ds, y0 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS y, y0 IS NULL AS is_gap FROM r""")
def regularise_rows_by_segment(spark, folder):
    sf = load_sales(
        table(spark, folder, "orders"), "o_orderdate", "o_totalprice", segment_col="o_orderpriority", freq="D"
    )
    return sf.df


# NULL values in the input itself: large orders lose their value.
@query("""WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS y FROM orders),
b AS (SELECT o_orderpriority, min(ds) AS lo, max(ds) AS hi FROM s GROUP BY 1),
g AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM b),
r AS (SELECT o_orderpriority, g.ds, s.y AS y0 FROM g LEFT JOIN s USING (o_orderpriority, ds))
SELECT o_orderpriority, ds, coalesce(y0, last_value(y0 IGNORE NULLS) OVER
  (PARTITION BY o_orderpriority ORDER BY ds, y0 NULLS FIRST ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS y, y0 IS NULL AS is_gap FROM r""")
def regularise_rows_with_missing(spark, folder):
    rows = table(spark, folder, "orders").withColumn(
        "amount", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    )
    return load_sales(rows, "o_orderdate", "amount", segment_col="o_orderpriority", freq="D").df


@query(f"""WITH {sql.series(*ORDERS, 'sum(o_totalprice)', PRIORITY)},{sql.filled(PRIORITY)},
i AS (SELECT *, count(*) FILTER (WHERE NOT is_gap) OVER (PARTITION BY o_orderpriority ORDER BY ds) AS island FROM f),
n AS (SELECT *, count(*) FILTER (WHERE is_gap) OVER (PARTITION BY o_orderpriority, island) AS gap FROM i)
SELECT o_orderpriority, ds, round(CASE WHEN NOT is_gap OR gap <= 3 THEN y END, 2) AS y, is_gap FROM n""")
def regularise_strict_by_priority(spark, folder):
    sf = orders_series(spark, folder, keys=PRIORITY, strict_gaps=True)
    return sf.df.select("o_orderpriority", "ds", F.round("y", 2).alias("y"), "is_gap")


@query(f"""WITH {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_returnflag', 'l_linestatus'], 'W-SUN')}
SELECT l_returnflag, l_linestatus, ds, y, is_gap FROM f""")
def calendar_weekly_sunday(spark, folder):
    sf = to_series(
        table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_returnflag", "l_linestatus"], freq="W-SUN"
    )
    return sf.df


@query(f"""WITH {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_partkey'], 'MS')}
SELECT l_partkey, ds, y, is_gap FROM f""")
def calendar_monthly_by_part(spark, folder):
    return to_series(
        table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_partkey"], freq="M"
    ).df


@query(f"""WITH {sql.prepared('lineitem', 'l_shipdate', 'sum(l_quantity)', ['l_suppkey'], 'QS')}
SELECT l_suppkey, ds, y, is_gap FROM f""")
def calendar_quarterly_by_supplier(spark, folder):
    return to_series(
        table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", keys=["l_suppkey"], freq="Q"
    ).df


# Mid-month stamps are off the grid: they stay, and month starts are added.
@query("""WITH s AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS ds, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority, min(ds) AS lo, max(ds) AS hi FROM s GROUP BY 1),
g AS (SELECT o_orderpriority, CAST(unnest(generate_series(date_trunc('month', lo) + INTERVAL 1 MONTH, CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ds FROM b),
r AS (SELECT o_orderpriority, ds, y AS y0 FROM s UNION ALL SELECT o_orderpriority, ds, NULL FROM g)
SELECT o_orderpriority, ds, coalesce(y0, last_value(y0 IGNORE NULLS) OVER
  (PARTITION BY o_orderpriority ORDER BY ds ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS y, y0 IS NULL AS is_gap FROM r""")
def calendar_off_grid(spark, folder):
    month = F.trunc(F.col("o_orderdate").cast("date"), "MONTH")
    rows = table(spark, folder, "orders").groupBy("o_orderpriority", F.date_add(month, 14).alias("ds")).agg(
        F.count(F.lit(1)).cast("double").alias("y")
    )
    return regularise(rows, "MS", ["o_orderpriority"], one_row_per_date=True)


@query(f"""WITH {sql.prepared(*ORDERS, 'sum(o_totalprice)', PRIORITY)}
SELECT o_orderpriority, count(*) FILTER (WHERE is_gap) AS missing, count(*) FILTER (WHERE y IS NULL) AS unfilled,
  min(ds) FILTER (WHERE is_gap) AS first_missing FROM f GROUP BY 1""")
def missing_dates_by_priority(spark, folder):
    sf = orders_series(spark, folder, keys=PRIORITY)
    return sf.df.groupBy("o_orderpriority").agg(
        F.count_if("is_gap").alias("missing"),
        F.count_if(F.isnull("y")).alias("unfilled"),
        F.min(F.when(F.col("is_gap"), F.col("ds"))).alias("first_missing"),
    )


_GRIDS = ("D", "W-MON", "W-SUN", "MS", "QS", "YS")


@query("WITH " + ", ".join(
    f"""d{i} AS (SELECT DISTINCT {sql._period('o_orderdate', f)} AS ds FROM orders),
l{i} AS (SELECT ds, ds - lag(ds) OVER (ORDER BY ds) AS gap FROM d{i}),
m{i} AS (SELECT count(*) AS n_dates, median(gap) AS m FROM l{i}),
a{i} AS (SELECT ['MON','TUE','WED','THU','FRI','SAT','SUN'][isodow(ds)] AS anchor FROM d{i} GROUP BY 1 ORDER BY count(*) DESC, min(ds) LIMIT 1)"""
    for i, f in enumerate(_GRIDS)) + " " + " UNION ALL ".join(
    f"""SELECT '{f}' AS grid, n_dates, m AS median_gap, CASE WHEN n_dates < 2 THEN 'D' WHEN m <= 1.5 THEN 'D' WHEN m <= 10 THEN 'W-' || anchor
  WHEN m <= 35 THEN 'MS' WHEN m <= 100 THEN 'QS' ELSE 'YS' END AS freq FROM m{i}, a{i}"""
    for i, f in enumerate(_GRIDS)))
def infer_frequency(spark, folder):
    # one table of days for all grids: its exchange is computed once
    rows = typed_rows(table(spark, folder, "orders"), "o_orderdate", "o_totalprice").select("ds").distinct()
    parts = [
        infer_freq(rows.withColumn("ds", cal.period_start(F.col("ds"), f))).select(
            F.lit(f).alias("grid"), "n_dates", "median_gap", "freq"
        )
        for f in _GRIDS
    ]
    return reduce(DataFrame.unionByName, parts)


# Orders as a text file would hold them: dates in several spellings, missing and unreadable cells.
_SPELLINGS = ["yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "d-MMM-yyyy", "MMM d, yyyy", None, " yyyy/M/d "]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 5 THEN CAST(o_orderdate AS DATE) END AS ds,
  CASE WHEN o_orderkey % 5 IN (0, 3) THEN o_totalprice END AS y, CASE WHEN o_orderkey % 7 = 5 THEN 'soon' END AS bad_date,
  CASE WHEN o_orderkey % 5 = 2 THEN '12,5x' END AS bad_value FROM orders""")
def typed_rows_text(spark, folder):
    orders = table(spark, folder, "orders")
    day, price = F.col("o_orderdate").cast("date"), F.col("o_totalprice").cast("string")
    spelt = F.lit("soon")
    for k, form in enumerate(_SPELLINGS):
        if form:
            spelt = F.when(F.col("o_orderkey") % 7 == k, F.date_format(day, form)).otherwise(spelt)
    cell = F.element_at(F.array(price, F.lit("n/a"), F.lit("12,5x"), F.concat(F.lit(" "), price, F.lit(" ")), F.lit("")),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = orders.select("o_orderkey", spelt.alias("day"), cell.alias("price"))
    return checked_rows(text, "day", "price", ["o_orderkey"])
