"""Fitted Holt-Winters and change-point trends by their definitions."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import forecast, smoothing, trend


def month_ends(n):
    first = dt.date(2015, 1, 1)
    out = []
    for i in range(n):
        y, m = divmod(first.month + i, 12)
        out.append(dt.date(first.year + y, m + 1, 1) - dt.timedelta(days=1))
    return out


def walk(y, m, a, b, g, level, slope, season):
    season, sse, fits = list(season), 0.0, []
    for t, v in enumerate(y):
        old = season[t % m]
        fits.append(level + slope + old)
        sse += (v - fits[-1]) ** 2
        up = a * (v - old) + (1 - a) * (level + slope)
        season[t % m] = g * (v - level - slope) + (1 - g) * old
        slope = b * (up - level) + (1 - b) * slope
        level = up
    return sse, fits


def many(seed, series=5, n=60):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return np.array([100 + r.normal() * t + 20 * np.sin(2 * np.pi * t / 12 + k) + np.cumsum(r.normal(0, 3, n)) + r.normal(0, 5, n) for k in range(series)])


def test_start_is_the_least_squares_one():
    y = many(1)
    weights = np.random.default_rng(2).uniform(0.05, 0.95, (len(y), 3))
    sse, start = smoothing.best_start(y, weights, 12, careful=True)
    for v, w, s, x in zip(y, weights, sse, start):
        assert abs(x[2:].sum()) < 1e-6
        assert walk(v, 12, *w, x[0], x[1], x[2:])[0] == pytest.approx(s, rel=1e-9)
        for i, d in itertools.product(range(14), (-0.5, 0.5)):
            z = x.copy()
            z[i] += d
            assert walk(v, 12, *w, z[0], z[1], z[2:])[0] >= s


def test_fit_is_at_least_as_good_as_a_grid(spark):
    y = many(3)
    rows = [(k, d, float(v)) for k, s in enumerate(y) for d, v in zip(month_ends(60), s)] + [(9, d, 1.0) for d in month_ends(20)]
    df = spark.createDataFrame(rows, "shop int, period_end date, v double").repartition(5)
    out, chosen = forecast.holt_winters_fitted(df, "v", keys=["shop"], h=4)
    got = {r["shop"]: r for r in chosen.collect()}
    assert set(got) == set(range(5))  # the short one is left out
    grid = np.array(list(itertools.product(np.linspace(0.05, 0.95, 10), repeat=3)))
    for k, s in enumerate(y):
        r = got[k]
        assert r["sse"] <= smoothing.best_start(np.repeat(s[None], len(grid), axis=0), grid, 12)[0].min() * (1 + 1e-9)
        sse, fits = walk(s, 12, r["alpha"], r["beta"], r["gamma"], r["level"], r["trend"], r["season"])
        assert sse == pytest.approx(r["sse"], rel=1e-9)
        mine = [x["fitted"] for x in out.where((F.col("shop") == k) & F.col("actual").isNotNull()).orderBy("period_end").collect()]
        assert mine == pytest.approx(fits)
    assert out.where("actual is null").count() == 20


def test_one_series_uses_many_tasks(spark):
    df = spark.createDataFrame(list(zip(month_ends(60), many(4)[0].tolist())), "period_end date, v double")
    out, chosen = forecast.holt_winters_fitted(df, "v", h=3)
    assert out.columns == ["period_end", "actual", "fitted"] and out.count() == 63 and chosen.count() == 1
    packed = forecast._series_arrays(df.withColumn("k", F.lit(1)), "v", "period_end", ["k"], 24)
    trials = packed.select("k", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("no")).repartition(forecast._tasks(df), "k", "no")
    used = trials.groupBy(F.spark_partition_id()).count().count()
    assert used >= min(4, forecast._tasks(df))
    with pytest.raises(ValueError):
        forecast.holt_winters_fitted(df.limit(20), "v")


def subgradient_gap(y, f):
    n = len(y)
    e = (y - f["yhat"][:n]) / f["scale"]
    pull = np.maximum(np.arange(n)[:, None] - np.array(f["places"])[None], 0).T @ e / (n - 1) / f["penalty"]
    d = np.array(f["delta"])
    return np.where(d == 0, np.maximum(np.abs(pull) - 1, 0), np.abs(pull - np.sign(d))).max(initial=0.0), e


@pytest.mark.parametrize("n", [12, 13, 17, 30, 48, 90, 240])
def test_changes_fulfil_the_conditions(n):
    r = np.random.default_rng(n)
    t = np.arange(n)
    y = 50 + 2 * t - 3 * np.maximum(t - n // 2, 0) + 5 * np.sin(2 * np.pi * t / 12) + r.normal(0, 1, n)
    f = trend.fit(y, 6, 3, 12.0, 0.8, 42)
    gap, e = subgradient_gap(y, f)
    assert gap < 1e-6 and abs(e.sum()) < 1e-8 and abs(e @ t) < 1e-6
    assert (f["lower"] <= f["yhat"]).all() and (f["yhat"] <= f["upper"]).all()


def test_a_bend_is_found_and_followed():
    t = np.arange(96)
    y = 40 + 1.0 * t - 1.5 * np.maximum(t - 48, 0) + 5 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(0, 0.3, 96)
    f = trend.fit(y, 12, 3, 12.0, 0.8, 42)
    true = 40 + np.arange(96, 108) - 1.5 * (np.arange(96, 108) - 48) + 5 * np.sin(2 * np.pi * np.arange(96, 108) / 12)
    assert np.abs(f["yhat"][96:] - true).max() < 3
    straight = trend.fit(y, 12, 3, 12.0, 0.8, 42, changes=0)
    assert np.abs(straight["yhat"][96:] - true).max() > 10 and straight["places"] == []
    again = trend.fit(y, 12, 3, 12.0, 0.8, 42)
    assert (again["lower"] == f["lower"]).all()
    width = f["upper"][96:] - f["lower"][96:]
    assert width[-1] > width[0]  # changes to come widen it


def test_series_side_by_side(spark):
    y = many(6, 3, 40)
    rows = [(f"s{k}", d, float(v)) for k, s in enumerate(y) for d, v in zip(month_ends(40), s)] + [("short", d, 1.0) for d in month_ends(5)]
    rows += [("flat", d, 0.0) for d in month_ends(15)]
    out, fits = trend.changepoint_forecast(spark.createDataFrame(rows, "k string, period_end date, v double"), "v", keys=["k"], h=2)
    assert {r["k"]: r["n"] for r in out.groupBy("k").agg(F.count("y").alias("n")).collect()} == {"s0": 40, "s1": 40, "s2": 40, "flat": 15}
    assert out.where("y is null").count() == 8 and fits.where("k = 'flat'").first()["delta"] == [0.0] * len(trend.change_places(15))
    one, _ = trend.changepoint_forecast(spark.createDataFrame(rows[:40], "k string, period_end date, v double"), "v", h=2)
    assert one.count() == 42 and "k" not in one.columns
