"""Fitted Holt-Winters (T3): start values by least squares inside a simplex search.

For fixed smoothing weights the one-step errors of the additive recursion are linear in the start
level, trend and season, so the best start is a small least-squares problem. What is
left to search is the three weights. The searches of many series, each from several starting points,
run side by side as numpy arrays; a search is a row of a Spark table, so one
long series uses as many tasks as many short ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starting points of the search, the same values for each weight, and the bounds of a weight.
STARTS = (0.05, 0.35, 0.65, 0.95)
BOUNDS = (1e-4, 1 - 1e-4)
_MOVE, _SETTLED = 0.15, 1e-7


def responses(y: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """One-step errors ``(n, batch, 1 + 2 + m)``: column 0 those from a start of zeros, the others what a unit
    of start level, trend and each season adds."""
    batch, n = y.shape
    a, b, g = (weights[:, i : i + 1] for i in range(3))
    columns = 3 + m
    level, trend = np.zeros((batch, columns)), np.zeros((batch, columns))
    season = np.zeros((m, batch, columns))
    level[:, 1] = trend[:, 2] = 1.0
    season[np.arange(m), :, 3 + np.arange(m)] = 1.0
    seen = np.zeros((batch, columns))
    errors = np.empty((n, batch, columns))
    for t in range(n):
        old = season[t % m]
        seen[:, 0] = y[:, t]
        carried = level + trend
        errors[t] = seen - carried - old
        new_level = a * (seen - old) + (1 - a) * carried
        season[t % m] = g * (seen - carried) + (1 - g) * old
        trend = b * (new_level - level) + (1 - b) * trend
        level = new_level
    return errors


def best_start(y: np.ndarray, weights: np.ndarray, m: int, careful: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The least squared error of each row's weights, and its start ``(level, trend, seasons that sum to 0)``."""
    errors = responses(y, weights, m).transpose(1, 0, 2)
    fixed, parts = errors[:, :, 0], errors[:, :, 1:]
    # a level up and all seasons down is the same start: the seasons' sum is held at 0
    seasons = np.concatenate([np.zeros(2), np.ones(m)])
    if careful:
        held = np.concatenate([parts, np.broadcast_to(seasons, (len(y), 1, 2 + m))], axis=1)
        wanted = np.concatenate([-fixed, np.zeros((len(y), 1))], axis=1)
        start = np.stack([np.linalg.lstsq(x, z, rcond=None)[0] for x, z in zip(held, wanted)])
    else:
        products = parts.transpose(0, 2, 1) @ parts + seasons[:, None] * seasons
        products += 1e-11 * np.trace(products, axis1=1, axis2=2)[:, None, None] * np.eye(2 + m)
        start = np.linalg.solve(products, -(parts.transpose(0, 2, 1) @ fixed[:, :, None]))[:, :, 0]
    left = fixed + (parts @ start[:, :, None])[:, :, 0]
    return (left * left).sum(axis=1), start


def search(y: np.ndarray, begin: np.ndarray, m: int, rounds: int = 150) -> np.ndarray:
    """Nelder-Mead for each row of ``y`` from its row of ``begin``, all rows together; the weights found."""
    cost = lambda x, rows: best_start(y[rows], np.clip(x, *BOUNDS), m)[0]
    rows = np.arange(len(y))
    corners = np.repeat(begin[:, None, :], 4, axis=1)
    for i in range(3):
        corners[:, i + 1, i] += np.where(begin[:, i] > 0.5, -_MOVE, _MOVE)
    value = np.stack([cost(corners[:, i], rows) for i in range(4)], axis=1)
    live = rows
    for _ in range(rounds):
        order = np.argsort(value[live], axis=1, kind="stable")
        corners[live] = np.take_along_axis(corners[live], order[:, :, None], axis=1)
        value[live] = np.take_along_axis(value[live], order, axis=1)
        spread = np.abs(corners[live] - corners[live, :1]).max(axis=(1, 2))
        live = live[spread > _SETTLED]
        if not len(live):
            break
        v, f = corners[live], value[live]
        centre, worst = v[:, :3].mean(axis=1), v[:, 3]
        mirror = np.clip(2 * centre - worst, *BOUNDS)
        f_mirror = cost(mirror, live)
        better, bad = f_mirror < f[:, 0], f_mirror >= f[:, 2]
        # beyond a new best; between centre and the better of worst and mirror if the mirror is no gain
        inner = np.where((f_mirror < f[:, 3])[:, None], mirror, worst)
        second = np.where(better[:, None], np.clip(3 * centre - 2 * worst, *BOUNDS), (centre + inner) / 2)
        f_second = np.full(len(live), np.inf)
        tried = better | bad
        if tried.any():
            f_second[tried] = cost(second[tried], live[tried])
        take_second = np.where(better, f_second < f_mirror, bad & (f_second < np.minimum(f_mirror, f[:, 3])))
        shrink = bad & ~take_second
        moved = np.where(take_second[:, None], second, mirror)
        f_moved = np.where(take_second, f_second, f_mirror)
        keep = ~shrink
        corners[live[keep], 3], value[live[keep], 3] = moved[keep], f_moved[keep]
        if shrink.any():
            at = live[shrink]
            for i in range(1, 4):
                corners[at, i] = (corners[at, i] + corners[at, 0]) / 2
                value[at, i] = cost(corners[at, i], at)
    return np.clip(corners[rows, value.argmin(axis=1)], *BOUNDS)


def fitted_parameters(packed: DataFrame, keys: list[str], m: int, starts: tuple[float, ...] = STARTS) -> DataFrame:
    """``packed`` (keys, ``ys`` array, other columns) with ``alpha, beta, gamma, level, trend, season, sse`` of each series.

    ``sse``: of all one-step errors from the fitted start. The searches of a series are dealt over
    all tasks; the one with the least error stays (ties: the first starting point).
    """
    spark = packed.sparkSession
    points = F.array(*[F.struct(F.lit(i).alias("no"), F.array(*map(F.lit, p)).alias("at")) for i, p in enumerate(itertools.product(starts, repeat=3))])
    fields = {f.name: f.dataType.simpleString() for f in packed.schema}
    trials = packed.select(*keys, "ys", F.explode(points).alias("p")).select(*keys, "ys", "p.no", "p.at")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trials = trials.repartition(tasks, *keys, "no")
    found = "no int, sse double, alpha double, beta double, gamma double, level double, trend double, season array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, same in pdf.groupby(pdf["ys"].map(len)):  # series of one length run together
                for lo in range(0, len(same), 256):
                    part = same.iloc[lo : lo + 256]
                    y = np.stack(part["ys"].to_numpy()).astype(float)
                    scale = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300)
                    weights = search(y / scale, np.stack(part["at"].to_numpy()).astype(float), m)
                    sse, start = best_start(y, weights, m, careful=True)
                    made = {"sse": sse, "alpha": weights[:, 0], "beta": weights[:, 1], "gamma": weights[:, 2], "level": start[:, 0], "trend": start[:, 1]}
                    yield part[[*keys, "no"]].assign(**made, season=list(start[:, 2:]))

    schema = ", ".join([f"`{k}` {fields[k]}" for k in keys] + [found])
    names = [c.split()[0] for c in found.split(", ")][1:]
    best = trials.mapInPandas(run, schema).groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("sse", "no")).alias("w")).select(*keys, "w.*")
    for k in keys:
        best = best.withColumnRenamed(k, f"_of_{k}")
    same = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        same = term if same is None else same & term
    return packed.join(best, same).drop(*[f"_of_{k}" for k in keys])
