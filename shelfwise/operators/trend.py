"""Trend with change points and yearly season (T4), many series at once.

A series is a level, a slope that may change at given places of its history, and Fourier terms. The
changes have a Laplace prior: least squares with an L1 penalty on them and nothing on the rest, which
coordinate descent and a last exact step on the changes left solve. Forecast intervals come
from simulated future changes, as many and as large as the past ones, under a fixed seed.
Spark deals the series to tasks by key; one series is a few hundred numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of possible changes, the share of the history they stand in, and the scale of their prior.
CHANGES, SHARE, PRIOR = 25, 0.8, 0.05
#: How often the noise, and with it the penalty, is estimated anew.
ROUNDS = 5


def change_places(n: int, changes: int = CHANGES, share: float = SHARE) -> np.ndarray:
    """Periods after which the slope may change, evenly over the first ``share`` of ``n`` periods."""
    last = int(np.floor(n * share)) - 1
    return np.unique(np.linspace(0, last, min(changes, max(last, 0)) + 1).round().astype(int)[1:])


def regressors(n: int, size: int, harmonics: int, period: float) -> np.ndarray:
    """Level, slope (1 over the ``n`` periods of the history) and Fourier terms of ``size`` periods; as many terms as ``n`` can bear."""
    t = np.arange(size, dtype=float)
    columns = [np.ones(size), t / max(n - 1, 1)]
    for k in range(1, min(harmonics, max((n - 4) // 4, 0)) + 1):
        columns += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.column_stack(columns)


def lasso(products: np.ndarray, target: np.ndarray, penalty: float, sweeps: int = 5000) -> np.ndarray:
    """Minimises ``d' products d / 2 - target' d + penalty * sum |d|`` by coordinate descent."""
    d = np.zeros(len(target))
    for _ in range(sweeps):
        before = d.copy()
        for j in np.flatnonzero(products.diagonal() > 1e-12):
            pull = target[j] - products[j] @ d + products[j, j] * d[j]
            d[j] = np.sign(pull) * max(abs(pull) - penalty, 0.0) / products[j, j]
        if np.abs(d - before).max(initial=0.0) < 1e-13:
            break
        held = np.flatnonzero(d)
        if len(held) and (np.sign(before) == np.sign(d)).all():
            # the same changes as a sweep ago: their exact values, if they keep their signs and no other wants in
            exact = np.zeros(len(d))
            exact[held] = np.linalg.lstsq(products[np.ix_(held, held)], target[held] - penalty * np.sign(d[held]), rcond=None)[0]
            pulls = target - products @ exact
            if (np.sign(exact) == np.sign(d)).all() and np.abs(pulls).max() <= penalty * (1 + 1e-9):
                return exact
    return d


def fit(y: np.ndarray, h: int, harmonics: int, period: float, interval: float, seed: int, changes: int = CHANGES,
        share: float = SHARE, prior: float = PRIOR, paths: int = 1000) -> dict:
    """One series: fitted and forecast values with bounds, trend, changes, penalty."""
    n, size = len(y), len(y) + h
    scale = np.abs(y).max() or 1.0
    z = y / scale
    free = regressors(n, size, harmonics, period)
    at = change_places(n, changes, share)
    time = np.arange(size) / max(n - 1, 1)
    hinges = np.maximum(time[:, None] - time[at][None, :], 0.0)
    basis = np.linalg.svd(free[:n], full_matrices=False)
    basis = basis[0][:, basis[1] > basis[1].max() * 1e-10]
    apart = lambda x: x - basis @ (basis.T @ x)
    own, target = apart(hinges[:n]), apart(z)
    products, delta, penalty = own.T @ own, np.zeros(len(at)), 0.0
    for _ in range(ROUNDS if len(at) else 0):
        # the noise that the last round left; half the periods count at least, so that it cannot vanish
        free_periods = max(n - basis.shape[1] - np.count_nonzero(delta), n / 2)
        penalty = max(((target - own @ delta) ** 2).sum() / free_periods, 1e-12) / prior
        delta = lasso(products, own.T @ z, penalty)
    bent = hinges @ delta
    coefficients = np.linalg.lstsq(free[:n], z - bent[:n], rcond=None)[0]
    trend = free[:, :2] @ coefficients[:2] + bent
    yhat = free @ coefficients + bent
    left = max(n - basis.shape[1] - np.count_nonzero(delta), 1)
    sigma = np.sqrt(((z - yhat[:n]) ** 2).sum() / left)
    draw = np.random.default_rng(seed)
    ahead = np.arange(1, h + 1) / max(n - 1, 1)
    size_of = np.abs(delta).mean() if len(delta) else 0.0
    count = draw.poisson(len(at) * ahead[-1], paths) if h else np.zeros(paths, int)
    moves = np.zeros((paths, h))
    for k, c in enumerate(count.tolist()):
        when, how = draw.uniform(0, ahead[-1], c), draw.laplace(0.0, size_of, c)
        moves[k] = np.maximum(ahead[:, None] - when[None, :], 0.0) @ how
    moves += draw.normal(0.0, 1.0, moves.shape) * sigma
    side = (1 - interval) / 2
    low, high = (np.quantile(moves, q, axis=0) for q in (side, 1 - side))
    from statistics import NormalDist

    z_side = NormalDist().inv_cdf(1 - side) * sigma
    return {
        "yhat": yhat * scale, "trend": trend * scale,
        "lower": (yhat + np.concatenate([np.full(n, -z_side), low])) * scale,
        "upper": (yhat + np.concatenate([np.full(n, z_side), high])) * scale,
        "places": at.tolist(), "delta": delta.tolist(), "penalty": float(penalty), "scale": float(scale),
    }


def changepoint_forecast(series: DataFrame, value: str, order: str = "period_end", keys: list[str] | None = None, h: int = 6,
                         harmonics: int = 3, period: float = 12.0, interval: float = 0.8, min_len: int = 12,
                         changes: int = CHANGES, share: float = SHARE, prior: float = PRIOR, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """T4: (rows: keys, ds, y (NULL for the future), yhat, yhat_lower, yhat_upper, trend;
    fits: keys, periods, scale, penalty, places, delta - a change of slope after each place, per whole history).

    The penalty is the noise left by the fit over the prior's scale. Series shorter than ``min_len`` are left out.
    """
    if not keys:
        rows, fits = changepoint_forecast(series.withColumn("_series", F.lit(1)), value, order, ["_series"], h, harmonics, period, interval, min_len,
                                          changes, share, prior, seed)
        return rows.drop("_series"), fits.drop("_series")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema)
    row = "struct<ds:date,y:double,yhat:double,yhat_lower:double,yhat_upper:double,trend:double>"
    schema = f"{kinds}, periods long, scale double, penalty double, places array<int>, delta array<double>, rows array<{row}>"
    columns = [*keys, "periods", "scale", "penalty", "places", "delta", "rows"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_len:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values(order)
        y = pdf[value].to_numpy(float)
        f = fit(y, h, harmonics, period, interval, seed, changes, share, prior)
        days = pd.to_datetime(pdf[order])
        days = [*days.dt.date, *[(days.iloc[-1] + pd.offsets.MonthEnd(k)).date() for k in range(1, h + 1)]]
        names = ("ds", "y", "yhat", "yhat_lower", "yhat_upper", "trend")
        rows = [dict(zip(names, r)) for r in zip(days, [*y.tolist(), *[None] * h], *(f[k].tolist() for k in ("yhat", "lower", "upper", "trend")))]
        made = [*pdf[keys].iloc[0].tolist(), len(y), f["scale"], f["penalty"], f["places"], f["delta"], rows]
        return pd.DataFrame([made], columns=columns)

    fits = series.select(*keys, order, value).groupBy(*keys).applyInPandas(one, schema)
    return fits.select(*keys, F.inline("rows")), fits.drop("rows")
