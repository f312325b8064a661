"""Online linear classifiers (M7c): SGD logistic regression, perceptron,
passive-aggressive, trained by iterative parameter mixing.

Rows never move: every epoch, each partition runs one pass of the online
update over its own rows (numpy inside ``mapInArrow``), starting from the
current weights, and returns the changes of the weights that its rows touched. Their
row-weighted average is summed on the executors; at most one number for each
feature (bounded by the vocabulary) reaches the driver, which
broadcasts the new weights for the next epoch. Prediction is another ``mapInPandas`` pass.

Input rows carry a sparse vector as two arrays (``indices``, ``values``) and a
0/1 label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import drop_shared, shared_table

LOSSES = ("log", "perceptron", "passive_aggressive")


def sparse_arrays(weights: DataFrame, id_col: str = "doc_id", index: str = "feature_index", value: str = "tfidf") -> DataFrame:
    """Long (id, index, value) rows -> (id, indices, values) sorted by index."""
    packed = weights.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("_p"))
    return packed.select(id_col, F.col(f"_p.{index}").alias("indices"), F.col(f"_p.{value}").alias("values"))


_BIAS, _ROWS, _LOST, _KEPT = -1, -2, -3, -4  # indices of the sums that are no weight


def _bytes(lists: pa.ListArray, kind: str) -> pa.Array:
    """The numbers of each row as bytes."""
    flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)
    ends = lists.offsets.to_numpy() * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _packed(batches):
    """Batches of (indices, values, label) with the two lists as bytes, which are read whole, and the label as true or false."""
    for b in batches:
        if len(b):
            up = pc.fill_null(pc.greater(b.column(2), 0), False)
            yield pa.record_batch([_bytes(b.column(0), "<i4"), _bytes(b.column(1), "<f8"), up], names=["i", "v", "up"])


class _Pass:
    """One pass of one loss over a partition. The weights are ``scale`` times a vector, so the decay of all of them is one
    multiplication and an update touches a row's own terms; what leaves the task are the changed terms."""

    def __init__(self, loss: str, alpha: float, c: float, t0: float, state: tuple[np.ndarray, float, float]):
        self.loss, self.alpha, self.c, self.t0 = loss, alpha, c, t0
        self.start, self.b, self.t = state
        self.v, self.scale, self.n, self.lost = self.start.copy(), 1.0, 0, 0.0

    def add(self, rows: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        loss, alpha, c, t0, v = self.loss, self.alpha, self.c, self.t0, self.v
        b, t, scale, lost = self.b, self.t, self.scale, self.lost
        for idx, val, y in rows:
            margin = scale * float(v[idx] @ val) + b
            lost += np.logaddexp(0.0, -y * margin) if loss == "log" else max(0.0, (loss != "perceptron") - y * margin)
            step = 0.0
            if loss == "log":
                eta = 1.0 / (alpha * (t0 + t))
                step = eta * y / (1.0 + np.exp(y * margin))
                scale *= 1.0 - eta * alpha
            elif loss == "perceptron":
                step = y if y * margin <= 0 else 0.0
            else:  # passive-aggressive (PA-I, hinge)
                short = max(0.0, 1.0 - y * margin)
                step = min(c, short / (float(val @ val) + 1.0)) * y
            if step:
                v[idx] += step / scale * val
                b += step
            t += 1
        self.b, self.t, self.scale, self.lost, self.n = b, t, scale, lost, self.n + len(rows)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.v != self.start)
        rest = {_BIAS: self.b * self.n, _ROWS: self.n, _LOST: self.lost, _KEPT: self.n * self.scale}
        changes = self.n * self.scale * (self.v[at] - self.start[at])
        return np.concatenate([at, list(rest)]), np.concatenate([changes, list(rest.values())])


def _epoch(alpha: float, c: float, t0: float, sent):
    """One pass over a partition for each loss of ``sent``: rows of (loss, index, sum)."""

    def run(batches):
        passes = {k: _Pass(k, alpha, c, t0, state) for k, state in sent.value.items()}
        for batch in batches:
            rows = []
            for i, v, up in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                rows.append((np.frombuffer(i.as_buffer(), "<i4").astype(np.int64), np.frombuffer(v.as_buffer(), "<f8"), 1.0 if up else -1.0))
            for one in passes.values():
                one.add(rows)
        for k, one in passes.items():
            at, value = one.sums()
            yield pa.record_batch([pa.array([k] * len(at)), pa.array(at), pa.array(value)], names=["loss", "i", "v"])

    return run


def fit_online_losses(data: DataFrame, dim: int, losses: tuple[str, ...] = LOSSES, epochs: int = 1000, alpha: float = 1e-4,
                      c: float = 1.0, tol: float = 1e-3, patience: int = 5) -> dict[str, tuple[np.ndarray, float]]:
    """Train each of ``losses`` by parameter mixing for at most ``epochs`` epochs; one stops when its mean loss of an epoch
    has not gone ``tol`` under its best one for ``patience`` epochs in a row. ``data`` is read once and its rows are stored
    as bytes; an epoch is one pass over these for all losses that still learn."""
    if unknown := set(losses) - set(LOSSES):
        raise ValueError(f"loss must be one of {LOSSES}, not {sorted(unknown)}")
    spark = data.sparkSession
    rows = shared_table(data.select("indices", "values", "label").mapInArrow(_packed, "i binary, v binary, up boolean"))
    parts = max(rows.rdd.getNumPartitions(), 1)
    state = {k: (np.zeros(dim), 0.0, 1.0) for k in losses}
    best, waited = dict.fromkeys(losses, np.inf), dict.fromkeys(losses, 0)
    t0 = 1.0 / alpha  # optimal-style schedule start: eta_1 = 1 / (alpha * t0) = 1
    live = list(dict.fromkeys(losses))
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast({k: state[k] for k in live})
        changes = rows.mapInArrow(_epoch(alpha, c, t0, sent), "loss string, i long, v double")
        # the partitions' changes, weighted by their rows, summed by index on the executors; the
        # driver gets at most dim + 4 numbers for each loss
        sums = changes.groupBy("loss", "i").agg(F.sum("v").alias("s")).toArrow()
        sent.unpersist()
        of, index, value = np.array(sums["loss"].to_pylist()), sums["i"].to_numpy(), sums["s"].to_numpy()
        for k in list(live):
            at, change = index[of == k], value[of == k]
            rest = dict(zip(at[at < 0].tolist(), change[at < 0].tolist()))
            total = rest.get(_ROWS, 0.0)
            if not total:
                live.remove(k)
                continue
            w, _, t = state[k]
            w = rest[_KEPT] / total * w
            w[at[at >= 0]] += change[at >= 0] / total
            state[k] = w, rest[_BIAS] / total, t + total / parts
            lost = rest[_LOST] / total
            waited[k] = 0 if lost < best[k] - tol else waited[k] + 1
            best[k] = min(best[k], lost)
            if waited[k] >= patience:
                live.remove(k)
        if not live:
            break
    drop_shared(rows)
    return {k: state[k][:2] for k in losses}


def fit_online(data: DataFrame, dim: int, loss: str = "log", epochs: int = 1000, alpha: float = 1e-4,
               c: float = 1.0, tol: float = 1e-3, patience: int = 5) -> tuple[np.ndarray, float]:
    """:func:`fit_online_losses` of one loss."""
    return fit_online_losses(data, dim, (loss,), epochs, alpha, c, tol, patience)[loss]


def margins(data: DataFrame, w: np.ndarray, b: float, id_col: str = "doc_id", name: str = "margin") -> DataFrame:
    """(id, margin) of each row: weights times values plus the intercept."""
    wb = data.sparkSession.sparkContext.broadcast((w, b))

    def run(batches):
        ww, bb = wb.value
        for pdf in batches:
            found = [float(ww[np.asarray(i, dtype=np.int64)] @ np.asarray(v, dtype=np.float64)) + bb for i, v in zip(pdf["indices"], pdf["values"])]
            yield pd.DataFrame({id_col: pdf[id_col], name: np.asarray(found, dtype=float)})

    return data.select(id_col, "indices", "values").mapInPandas(run, f"{id_col} long, {name} double")


def predict_online(data: DataFrame, w: np.ndarray, b: float, id_col: str = "doc_id") -> DataFrame:
    """Class 1 when the margin is positive."""
    return margins(data, w, b, id_col).select(id_col, (F.col("margin") > 0).cast("int").alias("prediction"))
