from datetime import date, timedelta

import numpy as np


def days(start, n, step=1):
    return [start + timedelta(days=step * i) for i in range(n)]


def mondays(n, start=date(2022, 1, 3)):
    return days(start, n, 7)


def months(n, year=2020):
    return [date(year + i // 12, i % 12 + 1, 1) for i in range(n)]


def growing_weekly(c, n=52, seed=42):
    rng = np.random.default_rng(seed)
    return [float(max(1.0, 100 * (1 + c / 52) ** i + rng.normal(0, 3))) for i in range(n)]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
