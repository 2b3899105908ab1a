"""Frequency strings and calendar expressions.

Fixed values: frequency names, their periods per year, seasonal cycle lengths
and the median-gap limits that tell one frequency from the next.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
ALIASES = {"M": "MS", "Q": "QS", "Y": "YS", "D": "D"}
GAP_LIMITS = ((1.5, "D"), (10.0, "W"), (35.0, "MS"), (100.0, "QS"), (400.0, "YS"))
PERIODS_PER_YEAR = {"D": 365, "W": 52, "MS": 12, "QS": 4, "YS": 1}
SEASONAL_PERIOD = {"D": 7, "W": 52, "MS": 12, "QS": 4, "YS": 1}

_TRUNC_UNIT = {"MS": "MONTH", "QS": "QUARTER", "YS": "YEAR"}
_STEP_MONTHS = {"MS": 1, "QS": 3, "YS": 12}


def family(freq: str) -> str:
    """`W-SUN` → `W`; other names stand for themselves."""
    return "W" if freq.startswith("W") else freq


def canonical(freq: str) -> str:
    """Canonical name of a frequency; plain `W` still needs an anchor day."""
    name = ALIASES.get(freq, freq)
    known = name in PERIODS_PER_YEAR or name in {f"W-{d}" for d in WEEKDAYS}
    if not known:
        raise ValueError(f"Unknown frequency {freq!r}")
    return name


def periods_per_year(freq: str, default: int = 365) -> int:
    return PERIODS_PER_YEAR.get(family(freq), default)


def seasonal_period(freq: str, default: int = 7) -> int:
    return SEASONAL_PERIOD.get(family(freq), default)


def is_sub_monthly(freq: str) -> bool:
    return family(freq) in ("D", "W")


def step(freq: str, n: Column | int = 1) -> Column:
    """Interval of `n` grid steps."""
    n = n if isinstance(n, Column) else F.lit(n)
    if freq in _STEP_MONTHS:
        return F.make_interval(months=n * _STEP_MONTHS[freq])
    return F.make_interval(days=n * (7 if family(freq) == "W" else 1))


def first_on_or_after(ds: Column, freq: str) -> Column:
    """First grid date that is not before `ds`."""
    if freq == "D":
        return ds
    if family(freq) == "W":
        return F.next_day(F.date_sub(ds, 1), freq[2:])
    start = F.trunc(ds, _TRUNC_UNIT[freq])
    return F.when(start == ds, ds).otherwise(F.add_months(start, _STEP_MONTHS[freq]))


def grid(first: Column, last: Column, freq: str) -> Column:
    """Grid dates in [first, last] as an array; empty when there are none."""
    start = first_on_or_after(first, freq)
    one = F.expr(f"INTERVAL {_STEP_MONTHS[freq]} MONTH") if freq in _STEP_MONTHS else F.expr(
        f"INTERVAL {7 if family(freq) == 'W' else 1} DAY"
    )
    return F.when(start <= last, F.sequence(start, last, one)).otherwise(F.array().cast("array<date>"))


def period_start(ds: Column, freq: str) -> Column:
    """The grid date of the period that contains `ds`."""
    if freq == "D":
        return ds
    if family(freq) == "W":
        return F.date_sub(F.next_day(ds, freq[2:]), 7)
    return F.trunc(ds, _TRUNC_UNIT[freq])


def future_date(last: Column, freq: str, i: Column) -> Column:
    """`i`-th grid date after `last`."""
    base = first_on_or_after(F.date_add(last, 1), freq)
    if freq in _STEP_MONTHS:
        return F.add_months(base, (i - 1) * _STEP_MONTHS[freq])
    return F.date_add(base, ((i - 1) * (7 if family(freq) == "W" else 1)).cast("int"))
