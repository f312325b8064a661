"""Forecasting for many series at once (T3 Holt-Winters, T4 trend + Fourier, T5 guards).

A series (one per key) is small after ``resample``: tens to hundreds of
periods. Each series becomes one ordered array; the recursive Holt-Winters
update is a SQL ``aggregate`` fold over that array with a struct state, so the
work is one task per series and series spread over all executors. Parameter
search explodes a fixed grid per series row (a generator, not a join) and
keeps the parameters with the smallest one-step squared error (``min_by``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import shared_table

GRID = [round(0.05 + 0.1 * i, 2) for i in range(10)]  # 0.05 .. 0.95
FINE_STEP, FINE_SPAN = 0.01, 5  # second search: best coarse value +- 5 steps of 0.01


def _series_arrays(series: DataFrame, value: str, order: str, keys: list[str], min_len: int) -> DataFrame:
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_a"))
    packed = packed.select(*keys, F.col("_a.v").alias("ys"), F.element_at(F.col("_a.o"), -1).alias("last"))
    return packed.where(F.size("ys") >= min_len)


def _walk(ys: Column, m: int, first: int, start: Column, weights: tuple[Column, ...], keep_fits: bool) -> Column:
    """Additive level/trend/season recursion over ``ys`` from its element ``first`` on.

    level_t  = a (y_t - s_{t-m}) + (1-a)(l_{t-1} + b_{t-1})
    trend_t  = b (l_t - l_{t-1}) + (1-b) b_{t-1}
    season_t = g (y_t - l_{t-1} - b_{t-1}) + (1-g) s_{t-m}
    fitted_t = l_{t-1} + b_{t-1} + s_{t-m}
    ``start``: struct (l, b, s); ``keep_fits``: the one-step values stand in the state (a search needs the
    squared error alone, and a list that grows with every step would make it quadratic).
    """
    a, b, g, a1, b1, g1 = weights
    fields = [start["l"].alias("l"), start["b"].alias("b"), start["s"].alias("s"), F.lit(0.0).alias("sse")]
    fields += [F.array().cast("array<double>").alias("fits")] if keep_fits else []

    def step(acc: Column, t: Column) -> Column:
        y = F.element_at(ys, t + 1)
        ph = t % m
        s_old = F.element_at(acc["s"], ph + 1)
        fit = acc["l"] + acc["b"] + s_old
        l_new = a * (y - s_old) + a1 * (acc["l"] + acc["b"])
        b_new = b * (l_new - acc["l"]) + b1 * acc["b"]
        s_val = g * (y - acc["l"] - acc["b"]) + g1 * s_old
        s_new = F.transform(acc["s"], lambda v, i: F.when(i == ph, s_val).otherwise(v))
        err = y - fit
        out = [l_new.alias("l"), b_new.alias("b"), s_new.alias("s"), (acc["sse"] + err * err).alias("sse")]
        return F.struct(*out, *([F.concat(acc["fits"], F.array(fit)).alias("fits")] if keep_fits else []))

    return F.aggregate(F.sequence(F.lit(first), F.size(ys) - 1), F.struct(*fields), step)


def _fold(ys: Column, m: int, a: Column, b: Column, g: Column, a1: Column, b1: Column, g1: Column, keep_fits: bool = True) -> Column:
    """:func:`_walk` from a first-season start: l = mean of season 1, b = (mean of season 2 - mean of
    season 1) / m, s_p = y_p - l for the first season."""
    first = F.slice(ys, 1, m)
    second = F.slice(ys, m + 1, m)
    s1 = F.aggregate(first, F.lit(0.0), lambda acc, v: acc + v)
    s2 = F.aggregate(second, F.lit(0.0), lambda acc, v: acc + v)
    l0 = s1 / m
    b0 = (s2 - s1) / m / m
    start = F.struct(l0.alias("l"), b0.alias("b"), F.transform(first, lambda v: v - l0).alias("s"))
    return _walk(ys, m, m, start, (a, b, g, a1, b1, g1), keep_fits)


def _forecast(state: Column, n: Column, m: int, h: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(h)),
        lambda k: state["l"] + k * state["b"] + F.element_at(state["s"], F.pmod(n - 1 + k, F.lit(m)) + 1),
    )


def _to_rows(packed: DataFrame, keys: list[str], order: str, m: int, h: int, freq_months: int, first: int | None = None) -> DataFrame:
    """Fitted rows from element ``first`` on (the second season, if not said), then ``h`` forecasts."""
    n, first = F.size("ys"), m if first is None else first
    fitted = packed.select(
        *keys, "last", "ys", "state", F.posexplode(F.col("state.fits")).alias("i", "fitted")
    ).select(
        *keys,
        F.last_day(F.add_months(F.col("last"), (F.col("i") + first + 1 - F.size("ys")) * freq_months)).alias(order),
        F.element_at("ys", F.col("i") + first + 1).alias("actual"),
        "fitted",
    )
    future = packed.select(*keys, "last", F.posexplode(_forecast(F.col("state"), n, m, h)).alias("k", "fitted")).select(
        *keys,
        F.last_day(F.add_months(F.col("last"), (F.col("k") + 1) * freq_months)).alias(order),
        F.lit(None).cast("double").alias("actual"),
        "fitted",
    )
    return fitted.unionByName(future)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def holt_winters_fitted(series: DataFrame, value: str, order: str = "period_end", keys: list[str] | None = None,
                        m: int = 12, h: int = 6, freq_months: int = 1) -> tuple[DataFrame, DataFrame]:
    """T3 as an optimiser fits it: smoothing weights by simplex search, start level, trend and season by
    least squares, all against the squared one-step errors of the whole series.

    Returns (rows: keys, period, actual, fitted - forecasts have NULL actual; per series
    ``alpha, beta, gamma, level, trend, season, sse``). Series with fewer than two seasons are left out.
    """
    from shelfwise.operators.smoothing import fitted_parameters

    if not keys:
        from shelfwise.operators.series import require_history

        series = require_history(series, 2 * m, "Holt-Winters").withColumn("_series", F.lit(1))
        rows, chosen = holt_winters_fitted(series, value, order, ["_series"], m, h, freq_months)
        return rows.drop("_series"), chosen.drop("_series")
    packed = _series_arrays(series, value, order, keys, 2 * m)
    fitted = shared_table(fitted_parameters(packed, keys, m))  # the search is not run again for each output
    names = ["alpha", "beta", "gamma"]
    weights = tuple(F.col(c) for c in names) + tuple(1 - F.col(c) for c in names)
    start = F.struct(F.col("level").alias("l"), F.col("trend").alias("b"), F.col("season").alias("s"))
    walked = fitted.withColumn("state", _walk(F.col("ys"), m, 0, start, weights, keep_fits=True))
    return _to_rows(walked, keys, order, m, h, freq_months, first=0), fitted.select(*keys, *names, "level", "trend", "season", "sse")


def holt_winters(series: DataFrame, value: str, order: str = "period_end", keys: list[str] | None = None,
                 m: int = 12, h: int = 6, params: tuple[float, float, float] | None = None,
                 grid: list[float] | None = None, freq_months: int = 1, refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """Additive-trend, additive-season Holt-Winters per series.

    ``params=(alpha, beta, gamma)`` fixes the smoothing; otherwise every grid
    triple is tried per series and the one with the smallest one-step SSE
    kept, then (``refine``) a finer grid of 0.01 steps around that triple is
    searched the same way, per series row. Series with fewer than two seasons
    are left out (T5). Returns
    (rows: keys, period, actual, fitted — forecasts have NULL actual;
    chosen parameters per series).
    """
    if not keys:  # one series: an internal constant key keeps every step a keyed job
        from shelfwise.operators.series import require_history

        series = require_history(series, 2 * m, "Holt-Winters")
        rows, chosen = holt_winters(series.withColumn("_series", F.lit(1)), value, order, ["_series"], m, h, params,
                                    grid, freq_months, refine)
        return rows.drop("_series"), chosen.drop("_series")
    packed = _series_arrays(series, value, order, keys, 2 * m)
    if params is not None:
        a, b, g = params
        lits = [F.lit(float(x)) for x in (a, b, g, 1 - a, 1 - b, 1 - g)]
        packed = packed.withColumn("state", _fold(F.col("ys"), m, *lits))
        chosen = packed.select(*keys, F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"),
                               F.col("state.sse").alias("sse"))
    else:
        grid = grid or GRID
        triples = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("g"))
                            for x, y, z in itertools.product(grid, grid, grid)])
        trials = packed.select(*keys, "ys", "last", F.explode(triples).alias("p"))
        trials = trials.repartition(_tasks(packed), *keys, "p")  # one long series uses all tasks
        p = F.col("p")
        trials = trials.withColumn(
            "sse", _fold(F.col("ys"), m, p["a"], p["b"], p["g"], 1 - p["a"], 1 - p["b"], 1 - p["g"], keep_fits=False)["sse"]
        )
        # the series rides along in min_by: no join back to the input
        pick = F.min_by(F.struct("p", "ys", "last"), "sse")
        best = trials.groupBy(*keys).agg(pick.alias("_w"), F.min("sse").alias("sse"))
        best = best.select(*keys, "_w.p", "_w.ys", "_w.last", "sse")
        if refine:
            offs = F.sequence(F.lit(-FINE_SPAN), F.lit(FINE_SPAN))

            def around(c: Column) -> Column:  # fine values around the coarse best, kept inside (0, 1)
                return F.filter(F.transform(offs, lambda o: F.round(c + o * FINE_STEP, 4)), lambda v: (v > 0) & (v < 1))

            fine = best.select(*keys, "ys", "last", "p", F.explode(around(F.col("p.a"))).alias("a"))
            fine = fine.select(*keys, "ys", "last", "p", "a", F.explode(around(F.col("p.b"))).alias("b"))
            fine = fine.select(*keys, "ys", "last", "a", "b", F.explode(around(F.col("p.g"))).alias("g"))
            fine = fine.repartition(_tasks(packed), *keys, "a", "b", "g")
            fine = fine.withColumn("p", F.struct("a", "b", "g")).withColumn(
                "sse", _fold(F.col("ys"), m, F.col("a"), F.col("b"), F.col("g"), 1 - F.col("a"), 1 - F.col("b"),
                             1 - F.col("g"), keep_fits=False)["sse"])
            best = fine.groupBy(*keys).agg(pick.alias("_w"), F.min("sse").alias("sse"))
            best = best.select(*keys, "_w.p", "_w.ys", "_w.last", "sse")
        chosen = best.select(*keys, F.col("p.a").alias("alpha"), F.col("p.b").alias("beta"), F.col("p.g").alias("gamma"), "sse")
        packed = best.select(*keys, "ys", "last", F.col("p.a").alias("alpha"), F.col("p.b").alias("beta"),
                             F.col("p.g").alias("gamma"))
        packed = packed.withColumn("state", _fold(
            F.col("ys"), m, F.col("alpha"), F.col("beta"), F.col("gamma"),
            1 - F.col("alpha"), 1 - F.col("beta"), 1 - F.col("gamma"),
        ))
    return _to_rows(packed, keys, order, m, h, freq_months), chosen


def fourier_forecast(series: DataFrame, value: str, order: str = "period_end", keys: list[str] | None = None,
                     h: int = 6, harmonics: int = 3, period: float = 12.0, interval: float = 0.8,
                     min_len: int = 12) -> DataFrame:
    """T4 (re-aimed): linear trend + yearly Fourier terms, least squares per
    series, with a normal interval from the residual standard deviation.
    Output per period: keys, ds, y (NULL for the future), yhat, yhat_lower, yhat_upper.

    The normal equations of each series are solved in one grouped pandas step
    (numpy ``lstsq`` on a series of a few hundred points); Spark partitions the
    series by key, so any number of series fit in parallel.
    """
    import numpy as np
    import pandas as pd
    from statistics import NormalDist

    keys = keys or []
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    key_types = {f.name: f.dataType.simpleString() for f in series.schema.fields if f.name in keys}
    schema = ", ".join([f"`{k}` {key_types[k]}" for k in keys] +
                       ["ds date", "y double", "yhat double", "yhat_lower double", "yhat_upper double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        n = len(pdf)
        if n < min_len:
            return pd.DataFrame(columns=[*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper"])
        t_all = np.arange(n + h, dtype=float)
        cols = [np.ones(n + h), t_all]
        for k in range(1, harmonics + 1):
            cols += [np.sin(2 * np.pi * k * t_all / period), np.cos(2 * np.pi * k * t_all / period)]
        X = np.column_stack(cols)
        if n < 2 * period:  # under two seasons trend and season are not told apart: least norm on a centred trend
            X[:, 1] = (X[:, 1] - (n - 1) / 2) / n
        y = pdf[value].to_numpy(dtype=float)
        coef, *_ = np.linalg.lstsq(X[:n], y, rcond=None)
        yhat = X @ coef
        resid_sd = float(np.std(y - yhat[:n], ddof=min(X.shape[1], n - 1)) if n > X.shape[1] else 0.0)
        last = pd.Timestamp(pdf[order].iloc[-1])
        future = [(last + pd.offsets.MonthEnd(k)).date() for k in range(1, h + 1)]
        ds = list(pd.to_datetime(pdf[order]).dt.date) + future
        out = pd.DataFrame({"ds": ds, "y": list(y) + [None] * h, "yhat": yhat,
                            "yhat_lower": yhat - z * resid_sd, "yhat_upper": yhat + z * resid_sd})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper"]]

    if not keys:
        one = series.withColumn("_series", F.lit(1))
        out = fourier_forecast(one, value, order, ["_series"], h, harmonics, period, interval, min_len)
        return out.drop("_series")
    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(fit, schema)
