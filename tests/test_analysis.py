import time
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import days, growing_weekly, mondays, months, rows
from pyspark.sql import functions as F

import ledgerwave as lw
from ledgerwave.operators import kernels, smoothing
from ledgerwave.operators.segments import ranked


# --- growth -------------------------------------------------------------------

STEPS = [100.0]
for pct in (-20, -10, 30, 20, -10, -30):
    STEPS.append(STEPS[-1] * (1 + pct / 100))


@pytest.mark.parametrize("unique", [True, False])
def test_inflections_are_sign_changes(frame, unique):
    d = mondays(7)
    gm = lw.growth_metrics(frame(list(zip(d, STEPS)), "W-MON", unique=unique), window=1)
    assert rows(gm.inflection_points, "ds") == [(d[3],), (d[5],)]
    assert gm.rolling.count() == 6


@pytest.mark.parametrize("c", [0.5, -0.5])
def test_growth_sign(frame, c):
    gm = lw.growth_metrics(frame(list(zip(mondays(52), growing_weekly(c))), "W-MON"))
    got = gm.summary.first()
    assert np.sign(got.cagr) == np.sign(c) and got.n_points == 52
    assert gm.rolling.count() == 48


@pytest.mark.parametrize("unique", [True, False])
def test_zero_base(frame, unique):
    d = days(date(2022, 1, 1), 5)
    gm = lw.growth_metrics(frame(list(zip(d, [0.0, 0.0, 5.0, 0.0, -1.0])), unique=unique), window=1)
    assert [r.growth for r in gm.rolling.orderBy("ds").collect()] == [float("inf"), -1.0, float("-inf")]
    assert gm.summary.first().cagr is None


# --- trend --------------------------------------------------------------------

def plain_loess(y, q, x, lo, hi, rho, n):
    """One local line at x over 0-based neighbours lo..hi, point by point."""
    h = max(x - lo, hi - x) + ((q - n) // 2 if q > n else 0)
    w = []
    for j in range(lo, hi + 1):
        r = abs(j - x)
        w.append(0.0 if r > 0.999 * h else rho[j] * (1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3))
    total = sum(w)
    if total <= 0:
        return None
    w = [v / total for v in w]
    a = sum(v * j for v, j in zip(w, range(lo, hi + 1)))
    c = sum(v * (j - a) ** 2 for v, j in zip(w, range(lo, hi + 1)))
    b = (x - a) / c if c ** 0.5 > 0.001 * (n - 1) else 0.0
    return sum(v * (1 + b * (j - a)) * y[j] for v, j in zip(w, range(lo, hi + 1)))


def plain_smooth(y, q, rho):
    n = len(y)
    out = []
    for i in range(n):
        lo = 0 if q >= n else min(max(0, i - (q - 1) // 2), n - q)
        fit = plain_loess(y, q, i, lo, min(n, lo + q) - 1, rho, n)
        out.append(y[i] if fit is None else fit)
    return out


def plain_stl(y, p, ns=7, inner=2, outer=15):
    n = len(y)

    def odd(x):
        k = int(np.ceil(x))
        return k + 1 - k % 2

    nt, nl = odd(1.5 * p / (1 - 1.5 / ns)), odd(p + 1)
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * p)
            for j in range(p):
                sub, wt = (y - trend)[j::p], rho[j::p]
                m = len(sub)
                mid = plain_smooth(sub, ns, wt)
                first = plain_loess(sub, ns, -1, 0, min(ns, m) - 1, wt, m)
                last = plain_loess(sub, ns, m, max(0, m - ns), m - 1, wt, m)
                cycle[j::p][: m + 2] = [mid[0] if first is None else first, *mid, mid[-1] if last is None else last]
            low = cycle
            for width in (p, p, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = cycle[p:p + n] - plain_smooth(low, nl, np.ones(n))
            trend = np.array(plain_smooth(y - season, nt, rho))
        if k < outer:
            r = np.abs(y - trend - season)
            c = 6 * np.median(r)
            rho = np.array([1.0 if v <= 0.001 * c else (1 - (v / c) ** 2) ** 2 if v <= 0.999 * c else 0.0 for v in r])
    return trend, season


@pytest.mark.parametrize("n,p", [(60, 12), (38, 7), (160, 52), (29, 4), (104, 52)])
def test_stl_kernel_matches_a_pointwise_one(n, p):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = 100 + 0.3 * t + 10 * np.sin(2 * np.pi * t / p) + rng.normal(0, 2, n)
    y[n // 2] += 60
    # two cycles are fitted exactly: no residual is left for robust rounds
    got, want = kernels.stl(y, p), plain_stl(y, p, outer=0 if n == 2 * p else 15)
    assert np.allclose(got[0][0], want[0], atol=1e-8) and np.allclose(got[1][0], want[1], atol=1e-8)
    both = kernels.stl(np.stack([y[::-1], y]), p)  # series of a batch do not touch each other
    assert np.allclose(both[0][1], want[0], atol=1e-8)


def test_stl_recovers_planted_parts(frame):
    t = np.arange(60)
    y = 200 + 2 * t + 25 * np.sin(2 * np.pi * t / 12)
    d = lw.decompose_trend(frame([(m, float(v)) for m, v in zip(months(60), y)], "MS"))
    got = d.components.orderBy("ds").toPandas()
    assert d.period == 12 and abs(got.residual).max() < 3
    assert np.allclose(got.trend + got.seasonal + got.residual, y)
    assert abs(got.seasonal.mean()) < 1 and got.trend.iloc[-1] - got.trend.iloc[0] == pytest.approx(118, abs=6)


@pytest.mark.parametrize("unique", [True, False])
def test_short_series_gets_a_centred_mean(frame, unique):
    y = growing_weekly(0.5)
    d = lw.decompose_trend(frame(list(zip(mondays(52), y)), "W-MON", unique=unique))
    got = d.components.orderBy("ds").toPandas()
    want = [np.mean(y[max(0, i - 13): i + 13]) for i in range(52)]
    assert d.period == 52 and np.allclose(got.trend, want) and (got.seasonal == 0).all()
    assert got.trend.iloc[-1] > got.trend.iloc[0]


# --- anomalies ----------------------------------------------------------------

def spiky(spike_at=30, jump=180.0, n=104):
    rng = np.random.default_rng(42)
    y = 200 + rng.normal(0, 5, n)
    y[spike_at] += jump
    return [(d, float(v)) for d, v in zip(mondays(n), y)]


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("method", ["zscore", "iqr", "iforest", "contextual"])
def test_spike_is_found(frame, method, unique):
    at = lw.detect_anomalies(frame(spiky(), "W-MON", unique=unique), method)
    got = at.anomalies.collect()
    assert mondays(104)[30] in {r.ds for r in got}
    assert {r.method for r in got} == {method} and all(r.label.endswith("expected") for r in got)
    top = max(got, key=lambda r: r.y)
    assert "above" in top.label and len(got) <= 12


def test_zscore_values(frame):
    data = spiky()
    y = np.array([v for _, v in data])
    z = (y - y.mean()) / y.std(ddof=1)
    got = lw.detect_anomalies(frame(data, "W-MON"), "zscore").anomalies.collect()
    assert [r.ds for r in got] == [data[i][0] for i in np.flatnonzero(abs(z) > 3)]
    assert got[0].score == pytest.approx(z[30]) and got[0].label == f"{z[30]:.1f}σ above expected"


def test_auto_method_and_errors(frame):
    data = spiky()
    assert lw.detect_anomalies(frame(data, "W-MON")).method == "contextual"
    assert lw.detect_anomalies(frame(data, "MS")).method == "zscore"
    assert lw.detect_anomalies(frame([(*r, "A") for r in data], "W-MON", segment="p")).method == "zscore"
    with pytest.raises(ValueError, match="Unknown method"):
        lw.detect_anomalies(frame(data, "W-MON"), "nope")
    assert lw.detect_anomalies(frame(data, "W-MON"), "iforest", 0.3).threshold == 0.05


@pytest.mark.parametrize("method", ["zscore", "iqr", "contextual"])
def test_constant_series_has_no_anomaly_but_a_schema(frame, method):
    at = lw.detect_anomalies(frame([(d, 100.0) for d in mondays(52)], "W-MON"), method)
    assert at.anomalies.count() == 0
    assert at.anomalies.columns == ["ds", "y", "score", "method", "label", "threshold"]


def test_contextual_looks_at_like_days(frame):
    rng = np.random.default_rng(1)
    y = 200 + rng.normal(0, 8, 104)
    y[::7] -= 100
    y[14] += 120
    got = lw.detect_anomalies(frame([(d, float(v)) for d, v in zip(days(date(2022, 1, 3), 104), y)]))
    assert days(date(2022, 1, 3), 104)[14] in {r.ds for r in got.anomalies.collect()}


def test_forest_routes_agree_on_share(frame):
    rng = np.random.default_rng(0)
    data = [(d, float(v)) for d, v in zip(days(date(2020, 1, 1), 900), rng.normal(0, 1, 900))]
    for unique in (True, False):
        n = lw.detect_anomalies(frame(data, unique=unique), "iforest").anomalies.count()
        assert 30 <= n <= 45  # 5 % of 900, ties at the cut are not flagged


def test_duplicate_dates_do_not_fail(frame):
    data = spiky() + spiky(50)
    assert lw.detect_anomalies(frame(data, "W-MON", unique=False), "zscore").anomalies.count() == 2


# --- segments -----------------------------------------------------------------

def three_segments(start=date(2022, 1, 3)):
    rng = np.random.default_rng(3)
    out = []
    for name, slope in (("A", 1.5), ("B", 0.0), ("C", -1.2)):
        y = np.maximum(150 + rng.normal(0, 5, 52) + np.linspace(0, slope * 40, 52), 1)
        out += [(d, float(v), name) for d, v in zip(mondays(52, start), y)]
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_ranking(frame, unique):
    sr = lw.compare_segments(frame(three_segments(), "W-MON", "product", unique))
    got = ranked(sr).orderBy("rank").collect()
    assert [r.segment for r in got] == ["A", "B", "C"] and [r["rank"] for r in got] == [1, 2, 3]
    assert got[0].trend_direction in ("up", "flat") and max(abs(r.cagr) for r in got) < 3
    latest = lw.compare_segments(frame(three_segments(), "W-MON", "product", unique), ranked_by="latest_value")
    values = [r.latest_value for r in latest.sorted().collect()]
    assert values == sorted(values, reverse=True)


@pytest.mark.parametrize("offset", range(7))
def test_ranking_does_not_depend_on_the_anchor(frame, offset):
    start = days(date(2022, 1, 3), 7)[offset]
    got = lw.compare_segments(frame(three_segments(start), f"W-{'MON TUE WED THU FRI SAT SUN'.split()[offset]}", "product"))
    base = lw.compare_segments(frame(three_segments(), "W-MON", "product"))
    assert rows(got.summary.select("segment", F.round("cagr", 9)), "segment") == rows(base.summary.select("segment", F.round("cagr", 9)), "segment")


def test_small_and_undefined_segments(frame):
    d = mondays(6)
    data = [(d[0], 5.0, "one")] + [(x, 0.0, "zero") for x in d] + [(x, 1.0 + i, "up") for i, x in enumerate(d)]
    got = lw.compare_segments(frame(data, "W-MON", "s")).sorted().collect()
    assert [(r.segment, r.trend_direction) for r in got] == [("up", "up"), ("zero", "flat")] and got[1].cagr is None


def test_rank_with_many_equal_and_missing_metrics(spark):
    from ledgerwave.core import SegmentRanking

    cagr = [None, 0.5, 0.5, -0.1, float("inf"), 0.5, None, float("-inf"), 0.0] * 4
    rows_ = [(f"s{i:02d}", c) for i, c in enumerate(cagr)]
    sr = SegmentRanking(spark.createDataFrame(rows_, "segment string, cagr double"), "cagr")
    want = sorted(rows_, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = ranked(sr).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 37)) and [r.segment for r in got] == [w[0] for w in want]
    assert [r.segment for r in sr.sorted().collect()] == [w[0] for w in want]


def test_segment_errors(frame):
    sf = frame([(d, 1.0) for d in mondays(5)], "W-MON")
    with pytest.raises(ValueError, match="needs a segment column"):
        lw.compare_segments(sf)
    with pytest.raises(ValueError, match="no column 'nope'"):
        lw.compare_segments(sf, by="nope")


# --- cohorts ------------------------------------------------------------------

def small_cohorts():
    w = mondays(4)
    return [(w[i], 1.0, "C1") for i in range(4)] + [(w[i], 1.0, "C2") for i in range(2)] + [(w[i], 1.0, "C3") for i in (1, 2, 3)]


def test_retention(frame):
    ct = lw.cohort_analysis(frame(small_cohorts(), "W-MON", "customer_id"), "customer_id")
    got = ct.retention.orderBy("cohort_start", "period_offset").collect()
    w = mondays(4)
    table = {c: [r.retention for r in got if r.cohort_start == c] for c in w[:2]}
    assert table == {w[0]: [1.0, 1.0, 0.5, 0.5], w[1]: [1.0, 1.0, 1.0, 0.0]}
    assert sorted({r.period_offset for r in got}) == [0, 1, 2, 3]


def test_retention_counts_rows_or_members(frame):
    w = mondays(3)
    data = [(w[0], 1.0, "a"), (w[0], 1.0, "b"), (w[1], 1.0, "a"), (w[1], 2.0, "a"), (w[2], 1.0, "a")]
    by_rows = lw.cohort_analysis(frame(data, "W-MON", "m", unique=False), "m").retention
    by_members = lw.cohort_analysis(frame(data, "W-MON", "m", unique=False), "m", count="distinct").retention
    assert [r.retention for r in by_rows.orderBy("period_offset").collect()] == [1.0, 1.0, 0.5]
    assert [r.retention for r in by_members.orderBy("period_offset").collect()] == [1.0, 0.5, 0.5]
    with pytest.raises(ValueError, match="cohort_col"):
        lw.cohort_analysis(frame(data, "W-MON", "m"), "nope")


# --- forecast -----------------------------------------------------------------

@pytest.mark.parametrize("kind", ["string", "bigint", "date"])
def test_rank_of_many_segments(spark, kind):
    """Ties, missing metrics, names with a long prefix in common, two keys."""
    rng = np.random.default_rng(6)
    rows = []
    for key in ("a", "b"):
        for k in rng.permutation(3000):
            name = {"string": f"segment of the shop number {k:05d}", "bigint": int(k), "date": date(1970, 1, 1) + timedelta(days=int(k))}[kind]
            value = None if k % 50 == 0 else 2.5 if k % 3 == 0 else 1e-9 * round(float(rng.normal(0, 50)))
            rows.append((key, name, value, float(k), "flat"))
    summary = spark.createDataFrame(rows, f"key string, segment {kind}, cagr double, latest_value double, trend_direction string")
    got = ranked(lw.SegmentRanking(summary.repartition(5), "cagr", ("key",))).collect()
    for key in ("a", "b"):
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1]))
        assert [r.segment for r in sorted((r for r in got if r.key == key), key=lambda r: r["rank"])] == [r[1] for r in want]
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 3001)] * 2)


def weekly_line(n):
    rng = np.random.default_rng(9)
    y = 500 + np.linspace(0, 100, n) + rng.normal(0, 5, n)
    return [(d, float(v)) for d, v in zip(mondays(n), y)]


def test_forecast_sizes(frame):
    with pytest.raises(ValueError, match="at least 4"):
        lw.forecast(frame(weekly_line(3), "W-MON"))
    for n in (52, 110):
        got = lw.forecast(frame(weekly_line(n), "W-MON"), 8).forecast.orderBy("step").collect()
        assert len(got) == 8 and got[0].ds == mondays(n + 1)[-1] and got[7].ds == mondays(n + 8)[-1]
        assert all(r.lower < r.yhat < r.upper for r in got) and 560 < got[0].yhat < 640


def smoothed(spark, series):
    """The fitted row of each (values, period)."""
    df = spark.createDataFrame([(i, [float(v) for v in y], m) for i, (y, m) in enumerate(series)], "i int, y array<double>, m int")
    return smoothing.fit(df.withColumn("n", F.size("y"))).orderBy("i").collect()


def plain_errors(y, m, start, a, b, g):
    """One-step errors and final (level, slope, ring) by the textbook's recursion."""
    level, slope, season, errors = start.l, start.b, list(start.ring), []
    for t, v in enumerate(y):
        errors.append(v - (level + slope + season[t]))
        new = level + slope + a * errors[-1]
        level, slope = new, slope + a * b * errors[-1]
        season.append(season[t] + g * errors[-1])
    return np.array(errors), level, slope, season[-m:]


def test_smoothing_follows_the_recursion(spark):
    rng = np.random.default_rng(2)
    t = np.arange(48)
    seasonal = 500 + 4 * t + 30 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 5, 48)
    series = [(seasonal, 12), (seasonal[::-1], 12), (seasonal[:31], 7), (rng.normal(0, 1, 9), 1), (np.arange(4.0), 1)]
    starts = [r.s for r in spark.createDataFrame(
        [(i, [float(v) for v in y], m) for i, (y, m) in enumerate(series)], "i int, y array<double>, m int").orderBy("i").select(
        smoothing.first_states(F.col("y"), F.size("y"), F.col("m")).alias("s")).collect()]
    line = np.polyfit(np.arange(1, 10), series[3][0], 1)
    assert np.allclose([starts[3].b, starts[3].l], line) and starts[3].ring == [0.0] and abs(sum(starts[0].ring)) < 1e-9
    for (y, m), start, row in zip(series, starts, smoothed(spark, series)):
        errors, level, slope, ring = plain_errors(y, m, start, row.a, row.b, row.g)
        assert np.allclose([row.state.s1, row.state.s2, row.state.l, row.state.b], [errors.sum(), (errors ** 2).sum(), level, slope])
        assert np.allclose(row.state.ring, ring) and (m > 1 or row.g == 0)
        tried = [(plain_errors(y, m, start, a, b, g)[0] ** 2).sum() for a in smoothing.COARSE for b in smoothing.COARSE
                 for g in (smoothing.COARSE if m > 1 else [0.0])]
        assert row.sse <= min(tried) * (1 + 1e-12) + 1e-12


def test_the_search_moves_many_series_at_once(spark):
    """Exactly what a fold of each series under each set gives, ties and sums that are not numbers included; 4,000
    series of 84 months, 206 sets each, are a few seconds' work."""
    rng = np.random.default_rng(4)
    y = np.round(100 + rng.normal(0, 20, (6, 30)), 1)
    y[1], y[2, 7], y[3, 3] = 5.0, np.inf, 1e200
    got = smoothed(spark, [(v, m) for v in y for m in (1, 4)])
    sets = F.expr("flatten(transform(array(a - 0.02, a, a + 0.02), x -> transform(array(b, b + 0.02), z -> struct(x AS a, z AS b))))")
    df = spark.createDataFrame([(r.i, r.y, r.n, r.m, r.a, r.b, r.g, r.sse) for r in got],
                               "i int, y array<double>, n int, m int, a double, b double, g double, sse double")
    start = smoothing.first_states(F.col("y"), F.col("n"), F.col("m"))
    own = smoothing.folded(F.col("y"), F.col("start"), F.col("a"), F.col("b"), F.col("g"))["s2"]
    near = F.array_min(F.transform(sets, lambda p: smoothing.folded(F.col("y"), F.col("start"), F.least(F.greatest(
        p["a"], F.lit(0.01)), F.lit(0.99)), F.least(p["b"], F.lit(0.99)), F.col("g"))["s2"]))
    for r in df.withColumn("start", start).select("i", "sse", own.alias("own"), near.alias("near")).collect():
        assert (r.own == r.sse or np.isnan([r.own, r.sse]).all()) and not r.near < r.sse * (1 - 1e-9)
    assert [(r.a, r.b) for r in got if r.i // 2 == 1] == [(0.01, 0.01)] * 2

    start = time.perf_counter()
    many = 100 + rng.normal(0, 20, (4000, 84))
    for rows in np.array_split(many, 40):
        smoothing.searched(rows, np.zeros((12, len(rows))), rows[:, 0], np.zeros(len(rows)))
    assert time.perf_counter() - start < 60


def test_seasonal_forecast_goes_on(frame):
    t = np.arange(60)
    y = 500 + 4 * t + 30 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(2).normal(0, 5, 60)
    got = lw.forecast(frame([(d, float(v)) for d, v in zip(months(48), y)], "MS"), 12).forecast.orderBy("step").collect()
    assert np.abs(np.array([r.yhat for r in got]) - (500 + 4 * t[48:] + 30 * np.sin(2 * np.pi * t[48:] / 12))).max() < 25


def test_many_series_and_rejects(frame):
    data = [(d, v, "long") for d, v in weekly_line(20)] + [(d, v, "short") for d, v in weekly_line(3)]
    fc = lw.forecast(frame(data, "W-MON", keys=("k",)), 2)
    assert rows(fc.forecast.select("k", "step"), "step") == [("long", 1), ("long", 2)]
    assert rows(fc.rejected.select("k", "n"), "k") == [("short", 3)]


# --- narration and annotation -------------------------------------------------

def say(result):
    return [r.text for r in lw.narrate(result).orderBy(F.col("ds").asc_nulls_first()).collect()]


def test_narration(frame):
    found = say(lw.detect_anomalies(frame(spiky(), "W-MON"), "zscore"))
    assert found[0] == "Found 1 anomalous period:" and found[1].startswith("  • 2022-08-01: ")
    none = say(lw.detect_anomalies(frame([(d, 1.0) for d in mondays(9)], "W-MON"), "zscore"))
    assert none == ["No notable findings. No anomalies detected in this period."]
    up = say(lw.growth_metrics(frame(list(zip(mondays(52), growing_weekly(0.5))), "W-MON")))[0]
    assert up.startswith("Overall trend: upward — compound annual growth rate of ")
    flat = say(lw.growth_metrics(frame([(d, 5.0) for d in mondays(9)], "W-MON")))[0]
    assert "Overall trend: flat — compound annual growth rate of 0.0%." in flat
    undefined = say(lw.growth_metrics(frame([(d, 0.0) for d in mondays(9)], "W-MON")))
    assert undefined == ["No notable findings. Could not compute growth rate."]
    top = say(lw.compare_segments(frame(three_segments(), "W-MON", "product")))[0]
    assert top.startswith("Top performer: A (CAGR ") and "Bottom performer: C (CAGR -" in top
    trend = say(lw.decompose_trend(frame(list(zip(mondays(52), growing_weekly(0.5))), "W-MON")))[0]
    assert trend == "Underlying trend: upward over the full period. Seasonal component strength (std): 0.00. Decomposition period: 52."
    fc = say(lw.forecast(frame(weekly_line(52), "W-MON"), 8))[0]
    assert fc.startswith("Forecast: 8 period(s) ahead. Projected range: ") and "(growing)" in fc
    ct = say(lw.cohort_analysis(frame(small_cohorts(), "W-MON", "c"), "c"))[0]
    assert ct == "Cohort analysis: 2 cohort(s) over up to 4 period(s). Average period-1 retention: 100% (strong)."
    only = say(lw.cohort_analysis(frame([(mondays(1)[0], 1.0, "x")], "W-MON", "c"), "c"))[0]
    assert only == "Cohort analysis: 1 cohort(s), only baseline period available."
    assert say(42) == ["No notable findings."]


def test_narration_of_empty_results(frame):
    empty = frame([], "W-MON", "s")
    assert say(lw.compare_segments(empty)) == ["No notable findings. No segments found."]
    assert say(lw.cohort_analysis(empty, "s")) == ["No notable findings. Cohort table is empty."]


def test_annotated_series_keeps_every_row(frame):
    sf = frame([*spiky(), (date(2024, 1, 1), None)], "W-MON")
    got = lw.plot_annotated(sf, lw.detect_anomalies(sf, "zscore"), lw.decompose_trend(sf)).toPandas()
    assert len(got) == 105 and got.is_anomaly.sum() == 1 and got.trend.isna().sum() == 1
    plain = lw.plot_annotated(sf, title="Sales").toPandas()
    assert (plain.title == "Sales").all()
    assert plain.trend.isna().all() and not plain.is_anomaly.any()
