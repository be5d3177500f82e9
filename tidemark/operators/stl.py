"""Robust seasonal-trend decomposition by LOESS (M1), per series.

Follows Cleveland, Cleveland, McRae and Terpenning (1990): inner loop of
cycle-subseries smoothing, low-pass filter and trend smoothing; outer loop
of bisquare robustness weights. Defaults as commonly published for STL:
seasonal smoother 7, trend span the smallest odd integer >= 1.5 p /
(1 - 1.5 / 7), low-pass span the smallest odd integer > p, local-linear
fits, 2 inner and 15 outer passes when robust.

Distribution: ``groupBy("series_key").applyInPandas``. A group is the
monthly rows of ONE series (bounded by the calendar span, never by the
raw data volume), and series are spread over tasks by the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STL_SCHEMA = "series_key string, period date, stl_trend double, stl_seasonal double, stl_resid double"


def _odd_at_least(x: float) -> int:
    v = int(np.ceil(x))
    return v + (v % 2 == 0)


def loess(y: np.ndarray, q: int, rw: np.ndarray | None = None, xe: np.ndarray | None = None) -> np.ndarray:
    """Local-linear LOESS of y (at 0..m-1) evaluated at ``xe`` with span q."""
    m = len(y)
    xs = np.arange(m, dtype=float)
    xe = xs if xe is None else np.asarray(xe, dtype=float)
    rw = np.ones(m) if rw is None else rw
    d = np.abs(xe[:, None] - xs[None, :])
    if q < m:
        h = np.sort(d, axis=1)[:, q - 1]
    else:
        h = d.max(axis=1) + (q - m) / 2.0
    h = np.maximum(h, 1e-12)
    r = d / h[:, None]
    w = np.where(r <= 0.999, np.where(r <= 0.001, 1.0, (1.0 - r ** 3) ** 3), 0.0) * rw[None, :]
    sw = w.sum(axis=1)
    ok = sw > 0
    w = np.where(ok[:, None], w / np.where(ok, sw, 1.0)[:, None], 0.0)
    a = (w * xs).sum(axis=1)
    c = (w * (xs[None, :] - a[:, None]) ** 2).sum(axis=1)
    rng = max(m - 1, 1)
    b = np.where(np.sqrt(c) > 0.001 * rng, (xe - a) / np.where(c > 0, c, 1.0), 0.0)
    w = w * (b[:, None] * (xs[None, :] - a[:, None]) + 1.0)
    out = (w * y[None, :]).sum(axis=1)
    if not ok.all():
        # every neighbour has zero robustness weight: fit those points unweighted
        if rw is not None and np.any(rw != 1.0):
            out = np.where(ok, out, loess(y, q, None, xe))
        else:
            out = np.where(ok, out, np.nan)
    return out


def _moving_average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.insert(x, 0, 0.0))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True):
    """Returns (trend, seasonal, resid)."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    ns = max(3, seasonal + (seasonal % 2 == 0))
    nt = _odd_at_least(1.5 * period / (1.0 - 1.5 / ns))
    nl = _odd_at_least(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    rw = np.ones(n)
    trend = np.zeros(n)
    season = np.zeros(n)
    for it in range(outer + 1):
        for _ in range(inner):
            detr = y - trend
            c = np.zeros(n + 2 * period)
            for k in range(period):
                sub = detr[k::period]
                m = len(sub)
                if m == 0:
                    continue
                vals = loess(sub, ns, rw[k::period], np.arange(-1, m + 1))
                c[k + period * np.arange(m + 2)] = vals
            low = _moving_average(_moving_average(_moving_average(c, period), period), 3)
            low = loess(low, nl)
            season = c[period:period + n] - low
            trend = loess(y - season, nt, rw)
        if it < outer:
            resid = np.abs(y - season - trend)
            h = 6.0 * np.median(resid)
            if h <= 0:
                break
            u = resid / h
            rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1.0 - u ** 2) ** 2, 0.0))
    return trend, season, y - trend - season


def stl_period(n: int) -> int:
    """12 for two years or more of months, else max(4, n // 4)."""
    return 12 if n >= 24 else max(4, n // 4)


def _per_series(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("period")
    y = pdf["sales"].to_numpy(dtype=float)
    n = len(y)
    out = pd.DataFrame({"series_key": pdf["series_key"].to_numpy(), "period": pdf["period"].to_numpy()})
    p = stl_period(n)
    if n < 2 * p or n < 4:
        out["stl_trend"] = np.nan
        out["stl_seasonal"] = np.nan
        out["stl_resid"] = np.nan
        return out
    t, s, r = stl(y, p)
    out["stl_trend"], out["stl_seasonal"], out["stl_resid"] = t, s, r
    return out


def decompose(monthly: DataFrame) -> DataFrame:
    """M1 over every series of a monthly frame (series_key, period, sales)."""
    return (monthly.select("series_key", "period", "sales")
                   .groupBy("series_key").applyInPandas(_per_series, STL_SCHEMA))


def with_stl(monthly: DataFrame) -> DataFrame:
    """Monthly frame with stl_trend / stl_seasonal joined back (same key)."""
    return monthly.join(decompose(monthly).drop("stl_resid"), ["series_key", "period"], "left")


def _train_then_extend(holdout: int, short_extra: int, max_lag: int):
    """STL on the train months of a series, extended over its holdout months
    the way the recursive forecast extends it: trend linear from the last two
    values, seasonal repeated from 12 rows earlier."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        y = pdf["sales"].to_numpy(dtype=float)
        n = len(y)
        n_fe = n - max_lag
        hold = holdout if n_fe > holdout + short_extra else max(2, n_fe // 4)
        n_train = n - hold
        out = pd.DataFrame({"series_key": pdf["series_key"].to_numpy(), "period": pdf["period"].to_numpy()})
        p = stl_period(n_train)
        if n_fe <= 0 or n_train < 2 * p or n_train < 4:
            out["stl_trend"] = np.nan
            out["stl_seasonal"] = np.nan
            out["stl_resid"] = np.nan
            return out
        t, s, _ = stl(y[:n_train], p)
        ahead = np.arange(1, hold + 1)  # n_train is 4 at least, so a slope exists
        trend = np.concatenate([t, t[-1] + (t[-1] - t[-2]) * ahead])
        cycle = s[-12:] if n_train >= 12 else s[-1:]
        season = np.concatenate([s, np.resize(cycle, hold)])
        out["stl_trend"], out["stl_seasonal"], out["stl_resid"] = trend, season, y - trend - season
        return out
    return run


def with_stl_train_only(monthly: DataFrame, holdout: int = 12, short_extra: int = 6,
                        max_lag: int = 12) -> DataFrame:
    """SN2: STL features for a backtest without look-ahead into the holdout."""
    d = (monthly.select("series_key", "period", "sales").groupBy("series_key")
                .applyInPandas(_train_then_extend(holdout, short_extra, max_lag), STL_SCHEMA))
    return monthly.join(d.drop("stl_resid"), ["series_key", "period"], "left")
