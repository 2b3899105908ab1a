"""Seasonal decomposition, for which Spark has no expression, in numpy.

It takes many series of one length at a time, as a matrix with a row per
series, so that a task's time goes into array operations.  Spark does the
grouping (see `batches.py`); each series is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np


# --- STL (Cleveland, Cleveland, McRae & Terpenning 1990) --------------------

def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


# Filled in each task: a plain dict travels to executors by value, a cached function by name only.
_NEIGHBOURS: dict = {}


def _neighbours(n: int, q: int):
    """For the places -1 … n: index, signed distance and tricube weight of the
    q nearest of n points."""
    if (n, q) not in _NEIGHBOURS:
        if len(_NEIGHBOURS) >= 64:
            _NEIGHBOURS.clear()
        _NEIGHBOURS[n, q] = _nearest(n, q)
    return _NEIGHBOURS[n, q]


def _nearest(n: int, q: int):
    at = np.arange(-1, n + 1)
    take = min(q, n)
    left = np.clip(at - (q + 1) // 2 + 1, 0, max(n - q, 0))
    idx = left[:, None] + np.arange(take)
    dist = idx - at[:, None]
    h = np.maximum(at - left, left + take - 1 - at).astype(float)
    if q > n:
        h += (q - n) // 2
    u = np.abs(dist) / np.maximum(h, 1e-300)[:, None]
    weight = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0))
    return idx, dist.astype(float), weight


def _local_lines(y, rho, q):
    """Robustly weighted local lines of every series at the places -1 … n."""
    n = y.shape[1]
    idx, dist, tri = _neighbours(n, q)
    w = rho[:, idx] * tri
    wy = w * y[:, idx]
    s0, t0 = w.sum(axis=2), wy.sum(axis=2)
    s1, s2 = np.einsum("smq,mq->sm", w, dist), np.einsum("smq,mq->sm", w, dist**2)
    t1 = np.einsum("smq,mq->sm", wy, dist)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, centre = t0 / s0, s1 / s0
        spread = s2 / s0 - centre**2
        line = mean - centre * (t1 / s0 - centre * mean) / spread
        fit = np.where(np.sqrt(np.maximum(spread, 0)) > 0.001 * (n - 1), line, mean)
    inner = np.where(np.isnan(fit[:, 1:-1]), y, fit[:, 1:-1])
    first = np.where(np.isnan(fit[:, :1]), inner[:, :1], fit[:, :1])
    last = np.where(np.isnan(fit[:, -1:]), inner[:, -1:], fit[:, -1:])
    return np.concatenate([first, inner, last], axis=1)


def _loess(y, rho, q):
    return _local_lines(y, rho, q)[:, 1:-1]


def _seasonal_pass(y, rho, period, q):
    """Smooth every cycle-subseries and extend it one cycle at both ends."""
    count, n = y.shape
    out = np.empty((count, n + 2 * period))
    cycles = np.array([(n - j - 1) // period + 1 for j in range(period)])
    for k in np.unique(cycles):
        phase = np.flatnonzero(cycles == k)
        at = phase[:, None] + period * np.arange(k)
        ext = _local_lines(y[:, at].reshape(-1, k), rho[:, at].reshape(-1, k), q)
        out[:, phase[:, None] + period * np.arange(k + 2)] = ext.reshape(count, len(phase), k + 2)
    return out


def _mean(x, width):
    c = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    return (c[:, width:] - c[:, :-width]) / width


def stl(y, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15):
    """Robust STL with degree-1 smoothers of every row of y → (trend, seasonal)."""
    y = np.atleast_2d(np.asarray(y, float))
    n = y.shape[1]
    trend_q, low_q = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend_out, season_out = np.empty_like(y), np.empty_like(y)
    live = np.arange(len(y))  # rows that still gain from robust rounds
    ones, rho = np.ones_like(y), np.ones_like(y)
    trend = np.zeros_like(y)
    for round_ in range(outer + 1):
        x = y[live]
        for _ in range(inner):
            cycle = _seasonal_pass(x - trend, rho, period, seasonal)
            low = _mean(_mean(_mean(cycle, period), period), 3)
            season = cycle[:, period : period + n] - _loess(low, ones[: len(x)], low_q)
            trend = _loess(x - season, rho, trend_q)
        trend_out[live], season_out[live] = trend, season
        r = np.abs(x - trend - season)
        scale = 6 * np.median(r, axis=1, keepdims=True)
        # A perfect fit (two cycles always give one) leaves only rounding noise to
        # weight by, which would make the result depend on the machine.
        more = scale[:, 0] > 1e-9 * np.abs(x).max(axis=1)
        if round_ == outer or not more.any():
            break
        live, trend = live[more], trend[more]
        u = r[more] / scale[more]
        rho = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return trend_out, season_out
