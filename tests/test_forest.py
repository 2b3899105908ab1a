"""The isolation forest against trees grown one node at a time in plain Python."""

import hashlib
import math
import time
from collections import Counter
from datetime import date

import numpy as np
import pytest
from helpers import days
from pyspark.sql import functions as F

import ledgerwave as lw
from ledgerwave import SalesFrame
from ledgerwave.operators import forest

START = days(date(2021, 1, 1), 400)


def digest(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def share(tree, node):
    x = (tree * 512 + node + 1) * 48271 % (2 ** 31 - 1)
    x = x * (x % 65536 + 1) % (2 ** 31 - 1) * 69621 % (2 ** 31 - 1)
    return x * (x % 65536 + 3) % (2 ** 31 - 1) / (2 ** 31 - 1)


def below(n):
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def plain_scores(rows):
    """Scores by value of one series of (date, value)."""
    copies, trees, total = Counter(), {}, len(rows)
    for ds, y in rows:
        fine = (y - math.floor(y)) * 2.0 ** 52
        h = digest(ds, math.floor(y), math.floor(fine), math.floor((fine - math.floor(fine)) * 2.0 ** 52), copies[ds, y])
        copies[ds, y] += 1
        arc = math.ceil(min(100.0, 25600.0 / total) - (h // 100) / float(2 ** 52 // 100))
        for step in range(arc):
            trees.setdefault((step - h % 100) % 100, []).append(y)
    limit = next(d for d in range(9) if min(total, 256) <= 2 ** d)

    def path(tree, values, y, node=1, depth=0):
        low, high = min(values), max(values)
        if low == high or depth >= limit:
            return depth * 2 ** 20 + round(below(len(values)) * 2 ** 20)
        cut = low + share(tree, node) * (high - low)
        cut = low if cut >= high else cut
        if y <= cut:
            return path(tree, [v for v in values if v <= cut], y, 2 * node, depth + 1)
        return path(tree, [v for v in values if v > cut], y, 2 * node + 1, depth + 1)

    usual = below(min(total, 256)) or 1.0
    return {y: 2.0 ** -(sum(path(t, v, y) for t, v in trees.items()) / 2.0 ** 20 / len(trees) / usual)
            for y in {y for _, y in rows}}


def flagged(rows):
    score = plain_scores(rows)
    cut = np.percentile([score[y] for _, y in rows], 95)
    return sorted((ds, y, round(score[y], 9)) for ds, y in rows if score[y] > cut)


def found(frame):
    got = lw.detect_anomalies(frame, "iforest").anomalies.collect()
    return sorted((r.ds, r.y, round(r.score, 9)) for r in got)


def values(kind, n):
    rng = np.random.default_rng(n)
    if kind == "ties":
        return [float(v) for v in rng.integers(0, 9, n)]
    if kind == "narrow":
        return [float(v) for v in 1.0 + rng.normal(0, 1e-9, n)]
    return [float(v) for v in np.round(rng.normal(0, 50, n), 2)]


@pytest.mark.parametrize("kind", ["plain", "ties", "narrow"])
@pytest.mark.parametrize("n", [1, 2, 3, 60, 400])
def test_one_row_per_date(frame, kind, n):
    rows = list(zip(START, values(kind, n)))
    assert found(frame(rows)) == flagged(rows)


@pytest.mark.parametrize("kind", ["plain", "ties", "narrow"])
def test_rows_that_share_dates(frame, kind):
    rows = [(START[k % 7], y) for k, y in enumerate(values(kind, 900))]
    assert found(frame(rows, unique=False)) == flagged(rows)


def test_both_ways_give_the_same_scores(frame):
    rows = list(zip(START, values("plain", 300)))
    assert found(frame(rows)) == found(frame(rows, unique=False)) != []


def test_series_do_not_meet(spark):
    rows = [(k, d, y) for k in ("a", "b") for d, y in zip(START, values("plain", 50 if k == "a" else 300))]
    df = spark.createDataFrame(rows, "k string, ds date, y double").withColumn("is_gap", F.lit(False))
    got = lw.detect_anomalies(SalesFrame(df, "D", ("k",), None, one_row_per_date=True), "iforest").anomalies
    for k in ("a", "b"):
        assert sorted((r.ds, r.y, round(r.score, 9)) for r in got.where(F.col("k") == k).collect()) == flagged(
            [(d, y) for g, d, y in rows if g == k])


def test_draws_are_as_many_as_asked_for(spark):
    """Whatever the size, a tree draws about 256 rows, copies of one row included, and no row twice."""
    rows = spark.range(200_000).select(
        (F.col("id") % 3 == 0).alias("same"), F.lit("2021-01-01").cast("date").alias("ds"), F.col("id").cast("double").alias("y"))
    rows = rows.withColumn("y", F.when(F.col("same"), 1.5).otherwise(F.col("y"))).groupBy("ds", "y").agg(F.count("*").alias("n"))
    points = forest.drawn(rows.withColumn("total", F.lit(200_000)), []).first().points
    sizes = [sum((t + p["first"]) % 100 < p["count"] for p in points) for t in range(100)]
    assert all(180 < n < 340 for n in sizes) and len(points) < 30_000
    assert 0.2 < sum(p.y == 1.5 for p in points) / len(points) < 0.45


def test_a_series_grows_in_milliseconds():
    """The steps of 400 series of 256 values, 100 trees each."""
    rng = np.random.default_rng(1)
    start = time.perf_counter()
    for _ in range(400):
        edge, change, trees = forest.grown(np.sort(rng.normal(0, 1, 256)), np.zeros(256, int), np.full(256, 100), 256)
        assert edge[0] == -math.inf and trees.sum() == trees[0] == 100 and (np.diff(edge) > 0).all()
    assert time.perf_counter() - start < 40


def test_shares_are_spread():
    got = sorted(share(t, n) for t in range(100) for n in range(1, 256))
    assert max(abs(v - (k + 0.5) / len(got)) for k, v in enumerate(got)) < 0.015
    assert abs(np.corrcoef([share(t, n) for t in range(100) for n in range(1, 128)],
                           [share(t, 2 * n) for t in range(100) for n in range(1, 128)])[0, 1]) < 0.03
