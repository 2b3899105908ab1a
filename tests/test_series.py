import contextlib
import io
from datetime import date, timedelta

import pytest
from helpers import days, mondays, rows
from pyspark.sql import functions as F

from ledgerwave import load_sales, to_series
from ledgerwave.sources.tables import write_typed
from ledgerwave.functions import calendar as cal
from ledgerwave.operators.series import infer_freq, regularise


def write_csv(tmp_path, name, header, data):
    path = tmp_path / name
    path.write_text("\n".join([header, *[",".join("" if v is None else str(v) for v in r) for r in data]]) + "\n")
    return str(path)


@pytest.fixture
def gaps_csv(tmp_path):
    sundays = days(date(2023, 1, 8), 52, 7)
    missing = {date(2023, 3, 19), date(2023, 3, 26), *days(date(2023, 8, 6), 5, 7)}
    data = [(d, float(100 + i)) for i, d in enumerate(sundays) if d not in missing]
    return write_csv(tmp_path, "gaps.csv", "date,amount", data)


def test_gaps_are_filled_up_to_three_periods(spark, gaps_csv):
    sf = load_sales(gaps_csv)
    got = {r.ds: (r.y, r.is_gap) for r in sf.df.collect()}
    assert sf.freq == "W-SUN" and len(got) == 52
    assert sum(g for _, g in got.values()) == 7
    assert got[date(2023, 3, 19)] == (109.0, True) and got[date(2023, 3, 26)] == (109.0, True)
    assert [got[d][0] for d in days(date(2023, 8, 6), 5, 7)] == [129.0, 129.0, 129.0, None, None]


def test_strict_gaps_leave_long_gaps_alone(spark, gaps_csv):
    got = {r.ds: r.y for r in load_sales(gaps_csv, strict_gaps=True).df.collect()}
    assert got[date(2023, 3, 19)] == 109.0
    assert all(got[d] is None for d in days(date(2023, 8, 6), 5, 7))


def test_weekly_anchor_follows_the_data(spark, tmp_path):
    path = write_csv(tmp_path, "s.csv", "date,amount", [(d, 100.0) for d in days(date(2023, 1, 1), 52, 7)])
    sf = load_sales(path, freq="W")
    assert sf.freq == "W-SUN" and sf.df.count() == 52 and sf.df.where("is_gap").count() == 0


def test_three_period_gap_is_flagged_and_filled(spark, tmp_path):
    data = [(d, 50.0 + i) for i, d in enumerate(mondays(20)) if i not in (4, 5, 6)]
    got = load_sales(write_csv(tmp_path, "g.csv", "date,amount", data)).df.where("is_gap").collect()
    assert [r.y for r in got] == [53.0, 53.0, 53.0]


def test_short_series_and_bad_input_raise(spark, tmp_path):
    short = write_csv(tmp_path, "a.csv", "date,amount", [(d, 1.0) for d in mondays(3)])
    with pytest.raises(ValueError, match="fewer than 4 periods"):
        load_sales(short)
    words = write_csv(tmp_path, "b.csv", "date,amount", [(d, "abc") for d in mondays(5)])
    with pytest.raises(TypeError, match="amount"):
        load_sales(words)
    with pytest.raises(ValueError, match="date_col"):
        load_sales(write_csv(tmp_path, "c.csv", "day,amount", [("2022-01-01", 1)]))
    with pytest.raises(ValueError, match="value_col"):
        load_sales(write_csv(tmp_path, "d.csv", "date,total", [("2022-01-01", 1)]))
    with pytest.raises(ValueError, match="as dates"):
        load_sales(write_csv(tmp_path, "e.csv", "date,amount", [("soon", 1)] * 5))


def test_date_spellings(spark, tmp_path):
    for i, (fmt, given) in enumerate([("%m/%d/%Y", None), ("%Y%m%d", None), ("%d.%m.%Y", "dd.MM.yyyy"), ("%Y-%m-%d 10:30:00", None)]):
        data = [(d.strftime(fmt), 1.0) for d in mondays(5)]
        sf = load_sales(write_csv(tmp_path, f"f{i}.csv", "date,amount", data), date_format=given)
        assert sf.freq == "W-MON" and sf.df.agg({"ds": "max"}).first()[0] == mondays(5)[-1]


def test_lazy_validation_fails_in_the_job(spark, tmp_path):
    words = write_csv(tmp_path, "b.csv", "date,amount", [(d, "abc") for d in mondays(5)])
    sf = load_sales(words, freq="W-MON", validate=False)
    with pytest.raises(Exception, match="bad number in amount"):
        sf.df.collect()


def test_shared_dates_and_transactions_are_kept(spark, tmp_path):
    data = [(d, 10.0, p) for p in "ABC" for d in mondays(20)]
    sf = load_sales(write_csv(tmp_path, "p.csv", "date,amount,product", data), segment_col="product")
    assert sf.df.count() == 60 and sf.segment_col == "product"
    data = [("2022-01-01", 10.0, "Q1")] * 5 + [("2022-04-01", 20.0, "Q2")] * 3
    sf = load_sales(write_csv(tmp_path, "t.csv", "date,amount,cohort", data), segment_col="cohort")
    assert rows(sf.df.groupBy("cohort").count(), "cohort") == [("Q1", 5), ("Q2", 3)]


def test_segments_keep_their_own_range_and_unknown_segment_is_ignored(spark, tmp_path):
    data = [(d, 1.0, "old") for d in mondays(8)] + [(d, 2.0, "new") for d in mondays(8, date(2022, 6, 6))]
    path = write_csv(tmp_path, "s.csv", "date,amount,cohort", data)
    sf = load_sales(path, segment_col="cohort")
    assert sf.df.where("cohort = 'new'").agg({"ds": "min"}).first()[0] == date(2022, 6, 6)
    assert sf.df.count() == 16
    assert load_sales(path, segment_col="nope").segment_col is None


def test_null_segment_rows_are_dropped(spark):
    df = spark.createDataFrame([(d, 1.0, s) for d in mondays(6) for s in ("A", None)], "date date, amount double, seg string")
    assert load_sales(df, segment_col="seg").df.count() == 6


def test_nulls_between_duplicates(spark):
    d = days(date(2022, 1, 1), 4)
    data = [(d[0], 5.0), (d[0], 7.0), (d[1], None), (d[1], None), (d[1], None), (d[1], None), (d[2], None), (d[3], 1.0), (d[3], None)]
    df = spark.createDataFrame(data, "ds date, y double")
    got = rows(regularise(df, "D"), "ds", "y")
    assert got == [
        (d[0], 5.0, False), (d[0], 7.0, False), (d[1], None, True), (d[1], 7.0, True), (d[1], 7.0, True),
        (d[1], 7.0, True), (d[2], None, True), (d[3], None, True), (d[3], 1.0, False),
    ]


@pytest.mark.parametrize("step,freq", [(1, "D"), (7, "W-SAT"), (30, "MS"), (91, "QS"), (365, "YS"), (500, "YS")])
def test_frequency_inference(spark, step, freq):
    df = spark.createDataFrame([(x, 1.0) for x in days(date(2022, 1, 1), 9, step)], "ds date, y double")
    assert infer_freq(df).first().freq == freq
    assert infer_freq(df.limit(1)).first().freq == "D"


def test_frequency_helpers():
    assert [cal.periods_per_year(f) for f in ("D", "W-SUN", "MS", "QS", "YS", "X")] == [365, 52, 12, 4, 1, 365]
    assert [cal.seasonal_period(f) for f in ("D", "W-MON", "MS", "QS", "YS", "X")] == [7, 52, 12, 4, 1, 7]
    assert [cal.is_sub_monthly(f) for f in ("D", "W-TUE", "MS")] == [True, True, False]
    assert [cal.canonical(f) for f in ("M", "Q", "Y", "D", "W-FRI")] == ["MS", "QS", "YS", "D", "W-FRI"]
    with pytest.raises(ValueError):
        cal.canonical("H")


def test_one_and_many_partitions_agree(spark):
    data = [(f"k{i % 5}", date(2022, 1, 1) + timedelta(days=(i * 7) % 60), float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, d date, v double")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(to_series(df, "d", "v", keys=["k"]).df, "k", "ds"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_typed_table_is_written_in_one_pass(spark, tmp_path):
    rows = [(1, "2022-01-03", "5"), (2, "soon", "6"), (3, None, "n/a"), (4, "1/4/2022", "x"), (5, "later", "y"), (6, "20220105", " 7.5 ")]
    df = spark.createDataFrame(rows, "id int, day string, price string")
    got = write_typed(df, str(tmp_path / "typed"), "day", "price", ["id"])
    assert (got.bad_dates, got.bad_values) == (2, 2)
    assert sorted(map(tuple, got.rows.collect())) == [(1, date(2022, 1, 3), 5.0), (3, None, None), (6, date(2022, 1, 5), 7.5)]
    bad = {r.id: (r.bad_date, r.bad_value) for r in got.bad_rows.collect()}
    assert bad == {2: ("soon", None), 4: (None, "x"), 5: ("later", "y")}
    plain = spark.createDataFrame([(1, date(2022, 1, 3), 5.0), (2, None, float("nan"))], "id int, day date, price double")
    got = write_typed(plain, str(tmp_path / "plain"), "day", "price", ["id"])
    assert (got.bad_dates, got.bad_values, got.bad_rows.count()) == (0, 0, 0) and got.rows.where("y IS NULL").count() == 1
    none = write_typed(df.where("false"), str(tmp_path / "none"), "day", "price")
    assert (none.bad_dates, none.rows.count()) == (0, 0)


def test_filling_sorts_a_series_once(spark):
    rows = spark.range(40).select(F.col("id") % 3, F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int") * 20).alias("ds"),
                                  F.col("id").cast("double").alias("y")).toDF("k", "ds", "y")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        to_series(rows, "ds", "y", keys=["k"], freq="M").df.explain()
    assert out.getvalue().count("- Sort [") == 1
