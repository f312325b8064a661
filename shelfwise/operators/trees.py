"""Decision tree, random forest and gradient boosting (M4, M5, M7) over binned features.

The method is MLlib's: candidate cuts near the quantiles of each feature (at most ``bins - 1``), a node takes the
cut with the largest gain (variance, or Gini index), a forest draws each row a Poisson(1) number of times for
each tree and a random part of the features for each node, boosting fits trees to the gradient of the squared or
logistic loss. Only the way of the rows differs, as MLlib passes over them for each level of each tree:

* few combinations of bins (:data:`GRID` at most): one distributed pass sums weights and targets by combination, for
  a forest with each tree's own draws of the rows, and a tree grows from these sums. Rows of one combination never
  part, so this is the same tree, whatever the number of rows.
* at most :data:`ENTRIES` binned values: they are stored once, by column; a task reads all of them and grows
  whole trees, a forest's trees dealt to all cores. Zeros of sparse vectors are not stored.
* more than that: MLlib's own estimators.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial, reduce
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import drop_shared, shared_table

#: Combinations of bins (by class, beyond two classes) up to which the rows are summed by combination.
GRID = 32_768
#: Binned values that one task may hold (8 bytes each for sparse vectors, 2 for dense ones).
ENTRIES = 24_000_000
#: Ranks of a feature that are looked at for its cuts, as many as MLlib draws.
RANKS = 10_000
#: Binned values of one step, which bounds the memory beside the stored ones.
STEP = 1 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TREE = "no int, feature binary, cut binary, left binary, value binary"


def find_cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts halfway between distinct ascending ``values`` with so many rows each: all, or those nearest to equal shares."""
    halfway = (values[:-1] + values[1:]) / 2
    if len(halfway) <= bins - 1:
        return halfway
    upto = np.cumsum(counts, dtype=float)
    stride, middles = upto[-1] / bins, upto[:-1] + upto[1:]
    target, at, found = stride, 0, []
    while True:
        at = max(at, int(np.searchsorted(middles, 2 * target, side="right")))
        if at >= len(halfway):
            return halfway[found]
        found.append(at)
        target, at = target + stride, at + 1


def _suffix(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x[..., ::-1], axis=-1)[..., ::-1]


def _gain(w: np.ndarray, s: np.ndarray, all_w: np.ndarray, all_s: np.ndarray) -> np.ndarray:
    """Fall of the impurity by splitting off a side with weight ``w`` and sums ``s`` (a row for each target); -1: no split."""
    left_w = all_w - w
    right, left, whole = (reduce(np.add, [x * x for x in side]) for side in (s, all_s - s, all_s))
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = right / w + left / left_w
        gain = sides - whole / all_w
    return np.where((w > 0.5) & (left_w > 0.5) & (gain > 1e-13 * sides), gain, -1.0)


def _sums(key: np.ndarray, w: np.ndarray | None, s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    weight = np.bincount(key, w, size).astype(float)
    return weight, np.stack([np.bincount(key, x, size) for x in s])


def _compact(key: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w[order], first), np.add.reduceat(s[:, order], first, axis=1)


class Dense:
    """Bins of every feature of every row: ``bins[f]`` counts the feature's cuts below the value."""

    def __init__(self, bins: list[np.ndarray], cuts: list[np.ndarray]):
        self.bins, self.cuts, self.rows, self.features = bins, cuts, len(bins[0]), len(bins)

    def best(self, rows, node, n, w, s, all_w, all_s, chosen, parents=None):
        """For each of ``n`` nodes the best gain, its feature and its cut; ``chosen``: (node, feature) pairs to look at."""
        gains, feature, cut = np.full(n, -1.0), np.full(n, -1), np.zeros(n, np.int64)
        for f, (b, cuts) in enumerate(zip(self.bins, self.cuts)):
            size = len(cuts) + 1
            if size < 2:
                continue
            key = node * np.int64(size) + b[rows]
            if n * size <= max(2 * len(rows), STEP):
                weight, sums = _sums(key, w, s, n * size)
                right_w, right_s = _suffix(weight.reshape(n, size))[:, 1:], _suffix(sums.reshape(-1, n, size))[:, :, 1:]
                gain = _gain(right_w, right_s, all_w[:, None], all_s[:, :, None])
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
            else:  # many nodes with few rows each: only bins that occur
                key, weight, sums = _compact(key, w, s)
                of = key // size
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                left_w, left_s = np.cumsum(weight) - weight, np.cumsum(sums, axis=1) - sums
                base = np.repeat(first, np.diff(np.r_[first, len(of)]))
                gain = _gain(all_w[of] - (left_w - left_w[base]), all_s[:, of] - (left_s - left_s[:, base]), all_w[of], all_s[:, of])
                gain[first] = -1.0  # no row to the left
                most = np.maximum.reduceat(gain, first)
                places = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[first, len(of)])))
                held, least = np.unique(of[places], return_index=True)
                top, at = np.full(n, -1.0), np.zeros(n, np.int64)
                top[of[first]] = most
                at[held] = key[np.maximum(places[least] - 1, 0)] % size  # behind the last bin that occurs to the left
            better = top > gains
            if chosen is not None:
                better &= (chosen == f).any(axis=1)
            gains[better], feature[better], cut[better] = top[better], f, at[better]
        return gains, feature, cut

    def right(self, rows, node, feature, cut):
        """Whether a row's bin lies beyond its node's cut; rows of nodes without a feature stay left."""
        out = np.zeros(len(rows), bool)
        of = feature[node]
        for f, b in enumerate(self.bins):
            mine = np.flatnonzero(of == f)
            out[mine] = b[rows[mine]] > cut[node[mine]]
        return out


class Sparse:
    """(row, bin) of the values beyond their feature's first bin, by feature and bin. Bins are numbered through all features:
    those of feature f begin at ``starts[f]``, and number ``starts[f] + c`` lies beyond the feature's cut c."""

    def __init__(self, row: np.ndarray, number: np.ndarray, cuts: list[np.ndarray], rows: int):
        self.row, self.number, self.cuts, self.rows, self.features = row, number, cuts, rows, len(cuts)
        self.starts = np.r_[0, np.cumsum([len(c) for c in cuts])]
        self.of = np.repeat(np.arange(len(cuts), dtype=np.int32), np.diff(self.starts))
        self.at = np.searchsorted(number, np.arange(self.starts[-1] + 1))  # where a bin's values begin

        self.held = None  # sums of the last level's nodes
        self.numbers = self.begins = None  # the same by row

    def _by_row(self) -> None:
        order = np.argsort(self.row.astype(_row_type(self.rows)), kind="stable")
        self.numbers = self.number[order]
        self.begins = np.r_[0, np.cumsum(np.bincount(self.row, minlength=self.rows))]

    def _node_sums(self, rows, node, n, w, s) -> tuple[np.ndarray, np.ndarray]:
        """Weights (node, bin) and sums (target, node, bin) of the values in some rows."""
        total = int(self.starts[-1])
        if n == 1 and w is None and len(rows) == self.rows and (np.diff(self.at) > 0).all():
            return np.diff(self.at)[None, :].astype(float), np.stack([np.add.reduceat(x[self.row], self.at[:-1])[None, :] for x in s])
        if self.numbers is None:
            self._by_row()
        weight, sums = np.zeros(n * total), np.zeros((len(s), n * total))
        sizes = (self.begins[1:] - self.begins[:-1])[rows]
        upto = np.cumsum(sizes)
        lo = 0
        while lo < len(rows):
            hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4 * STEP)), lo + 1)
            part, size = slice(lo, hi), sizes[lo:hi]
            begin = self.begins[rows[part]] - np.cumsum(size) + size
            key = self.numbers[np.arange(size.sum()) + np.repeat(begin, size)] + np.repeat(node[part] * total, size)
            a, b = _sums(key, None if w is None else np.repeat(w[part], size), (np.repeat(x[part], size) for x in s), n * total)
            weight += a
            sums += b
            lo = hi
        return weight.reshape(n, total), sums.reshape(-1, n, total)

    def _pick(self, number, weight, sums, all_w, all_s) -> tuple[float, int]:
        """The best gain of a node and the lowest bin that goes right, from its rows' sums by bin (ascending)."""
        of = self.of[number]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[first, len(of)])

        def beyond(x):  # from a bin to its feature's last one
            upto = np.cumsum(x, axis=-1)
            return np.repeat(upto[..., first + size - 1], size, axis=-1) - upto + x

        gain = _gain(beyond(weight), beyond(sums), all_w, all_s[:, None])
        i = int(gain.argmax())
        return gain[i], number[i - 1] + 1 if i and of[i - 1] == of[i] else self.starts[of[i]]

    def best(self, rows, node, n, w, s, all_w, all_s, chosen, parents=None):
        """As that of :class:`Dense`; with ``parents``, nodes 2 i and 2 i + 1 are the children of node ``parents[i]`` of the call
        before, and only the smaller one of two is summed."""
        gains, feature, cut = np.full(n, -1.0), np.full(n, -1), np.zeros(n, np.int64)
        total = int(self.starts[-1])
        if not total:
            return gains, feature, cut
        if chosen is None and n * total <= 10 * STEP:
            if parents is None or self.held is None:
                self.held = self._node_sums(rows, node, n, w, s)
            else:
                count = np.bincount(node, minlength=n)
                less = count.reshape(-1, 2).argmin(axis=1)  # of each pair
                mine = np.flatnonzero(less[node >> 1] == (node & 1))
                few_w, few_s = self._node_sums(rows[mine], node[mine] >> 1, n // 2, None if w is None else w[mine], s[:, mine])
                many_w, many_s = self.held[0][parents] - few_w, self.held[1][:, parents] - few_s
                weight, sums = np.empty((n, total)), np.empty((len(s), n, total))
                at = 2 * np.arange(n // 2) + less
                weight[at], weight[at ^ 1], sums[:, at], sums[:, at ^ 1] = few_w, many_w, few_s, many_s
                self.held = weight, sums
            at = np.zeros(n, np.int64)
            for i in range(n):
                number = np.flatnonzero(self.held[0][i] > 0.5)
                if len(number):
                    gains[i], at[i] = self._pick(number, self.held[0][i][number], self.held[1][:, i][:, number], all_w[i], all_s[:, i])
        else:
            self.held = None
            full_node = np.full(self.rows, -1, np.int32)
            full_node[rows] = node
            full_w, full_s = np.zeros(self.rows), np.zeros((len(s), self.rows))
            full_w[rows], full_s[:, rows] = 1.0 if w is None else w, s
            place, of_node = self._looked_at(full_node, n, chosen)
            if not len(place):
                return gains, feature, cut
            row, number = self.row[place], self.number[place]
            key, weight, sums = _compact(of_node * np.int64(total) + number, full_w[row], full_s[:, row])
            node_of, at = key // total, np.zeros(n, np.int64)
            first = np.flatnonzero(np.r_[True, node_of[1:] != node_of[:-1]])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                i = node_of[lo]
                gains[i], at[i] = self._pick(key[lo:hi] - i * total, weight[lo:hi], sums[:, lo:hi], all_w[i], all_s[:, i])
        found = gains > 0
        feature[found] = self.of[at[found]]
        cut[found] = at[found] - self.starts[feature[found]]
        return gains, feature, cut

    def _looked_at(self, node: np.ndarray, n: int, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values whose feature their row's node looks at, and the nodes."""
        if chosen is not None:
            lo, hi = self.at[self.starts[chosen]].ravel(), self.at[self.starts[chosen + 1]].ravel()
            size = hi - lo
            if size.sum() <= 2 * STEP:
                place = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
                own = np.repeat(np.repeat(np.arange(n), chosen.shape[1]), size)
                kept = node[self.row[place]] == own
                return place[kept], own[kept]
            looks = np.zeros((n, self.features), bool)
            looks[np.arange(n)[:, None], chosen] = True
        places = []
        for lo in range(0, len(self.row), STEP):
            here = node[self.row[lo:lo + STEP]]
            kept = here >= 0
            if chosen is not None:
                kept &= looks[here, self.of[self.number[lo:lo + STEP]]]
            places.append(lo + np.flatnonzero(kept))
        place = np.concatenate(places)
        return place, node[self.row[place]]

    def right(self, rows, node, feature, cut):
        full = np.full(self.rows, -1, np.int32)
        full[rows] = node
        out = np.zeros(self.rows, bool)
        for a in np.flatnonzero(feature >= 0):
            row = self.row[self.at[self.starts[feature[a]] + cut[a]]:self.at[self.starts[feature[a] + 1]]]
            out[row[full[row] == a]] = True
        return out[rows]


@dataclass
class Tree:
    """Nodes in order of their levels; ``left`` is the left child (the right one follows it), -1 at a leaf; ``value``: a row
    for each target."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            moving = moving[self.left[node[moving]] >= 0]
            at = node[moving]
            node[moving] = self.left[at] + (x[moving, self.feature[at]] > self.cut[at])
        return node

    def merged(self, classes: int) -> Tree:
        """Leaves of one node that stand for the same class as one leaf, as MLlib prunes."""
        self.left = self.left.copy()
        of = (self.value[0] > 0.5).astype(int) if classes == 2 else self.value.argmax(axis=0)
        while True:
            inner = np.flatnonzero(self.left >= 0)
            a, b = self.left[inner], self.left[inner] + 1
            alike = inner[(self.left[a] < 0) & (self.left[b] < 0) & (of[a] == of[b])]
            if not len(alike):
                return self
            self.left[alike] = -1

    def packed(self) -> list[bytes]:
        return [self.feature.astype(np.int32).tobytes(), self.cut.astype(float).tobytes(), self.left.astype(np.int32).tobytes(), self.value.astype(float).tobytes()]

    @staticmethod
    def unpacked(feature: bytes, cut: bytes, left: bytes, value: bytes) -> Tree:
        feature = np.frombuffer(feature, np.int32)
        return Tree(feature, np.frombuffer(cut), np.frombuffer(left, np.int32), np.frombuffer(value).reshape(-1, max(len(feature), 1)))


def _choose(rng: np.random.Generator, nodes: int, features: int, part: int) -> np.ndarray:
    """``part`` different features for each node."""
    if part * 4 > features:
        return np.argsort(rng.random((nodes, features)), axis=1)[:, :part]
    out = np.sort(rng.integers(features, size=(nodes, part)), axis=1)
    while (again := np.c_[np.zeros(nodes, bool), out[:, 1:] == out[:, :-1]]).any():
        out[again] = rng.integers(features, size=int(again.sum()))
        out.sort(axis=1)
    return out


def grow(store, w: np.ndarray | None, s: np.ndarray, depth: int, part: int | None = None, rng: np.random.Generator | None = None) -> tuple[Tree, np.ndarray]:
    """A tree from rows with weights ``w`` (None: 1 each) and weighted targets ``s`` (a row for each target); also every
    row's leaf. ``part``: features drawn for each node."""
    rows = np.arange(store.rows) if w is None else np.flatnonzero(w > 0)
    node, leaf = np.zeros(len(rows), np.int64), np.zeros(store.rows, np.int64)
    all_w, all_s = np.array([len(rows) if w is None else w.sum()], float), s.sum(axis=1)[:, None]
    features, cuts, lefts, values, made, parents = [], [], [], [], 1, None
    for level in range(depth + 1):
        n = len(all_w)
        values.append(all_s / np.maximum(all_w, 1e-300))
        own_w = None if w is None else w[rows]
        chosen = _choose(rng, n, store.features, part) if part is not None and part < store.features and level < depth else None
        if level < depth and len(rows):
            if own_w is None and isinstance(store, Dense):
                own_w = np.ones(len(rows))
            gain, feature, cut = store.best(rows, node, n, own_w, s[:, rows], all_w, all_s, chosen, parents)
            feature = np.where(gain > 0, feature, -1)
        else:
            feature, cut = np.full(n, -1), np.zeros(n, np.int64)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        features.append(feature)
        cuts.append(np.array([store.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())]))
        lefts.append(np.where(split, made + 2 * rank, -1))
        if not split.any():
            break
        parents = np.flatnonzero(split)
        right = store.right(rows, node, feature, cut)
        kept = split[node]
        rows, node = rows[kept], (2 * rank[node] + right)[kept]
        leaf[rows] = made + node
        n, made = 2 * int(split.sum()), made + 2 * int(split.sum())
        all_w, all_s = _sums(node, None if w is None else w[rows], s[:, rows], n)
    return Tree(np.concatenate(features), np.concatenate(cuts), np.concatenate(lefts), np.concatenate(values, axis=1)), leaf


def boost(store, y: np.ndarray | None, w: np.ndarray | None, ones: np.ndarray | None, trees: int, depth: int, step: float) -> list[Tree]:
    """Boosted trees: of weighted targets ``y``, or for classes of the weight ``ones`` of class 1 among ``w``."""
    each = np.ones(store.rows) if w is None else w
    first = y if ones is None else 2 * ones - each
    margin, out = np.zeros(store.rows), []
    for no in range(trees):
        if not no:
            pull = first
        elif ones is None:
            pull = 2 * (y - each * margin)
        else:
            pull = 4 * ones / (1 + np.exp(2 * margin)) - 4 * (each - ones) / (1 + np.exp(-2 * margin))
        tree, leaf = grow(store, w, pull[None, :], depth)
        tree.value *= step if no else 1.0
        margin += tree.value[0][leaf]
        out.append(tree)
    return out


@dataclass
class Trees:
    """Fitted trees; ``transform`` adds ``prediction`` and for classes ``probability``."""

    kind: str
    features: str
    classes: int
    trees: list[Tree]
    middle: float = 0.0

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' values (a row for each target), or a boosted sum."""
        total = sum(t.value[:, t.leaves(x)] for t in self.trees)
        return total if self.kind == "boosting" else total / len(self.trees)

    def probabilities(self, out: np.ndarray) -> np.ndarray:
        if self.kind == "boosting":
            out = 1 / (1 + np.exp(-2 * out))
        return np.stack([1 - out[0], out[0]], axis=1) if self.classes == 2 else out.T

    def predictions(self, out: np.ndarray) -> np.ndarray:
        if not self.classes:
            return out[0] + self.middle
        if self.kind == "boosting":
            return (out[0] > 0).astype(float)
        return (out[0] > 0.5).astype(float) if self.classes == 2 else out.argmax(axis=0).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        used = np.unique(np.concatenate([t.feature[t.left >= 0] for t in self.trees]))
        slim = [Tree(np.searchsorted(used, np.where(t.left >= 0, t.feature, used[0] if len(used) else 0)), t.cut, t.left, t.value) for t in self.trees]
        shared = df.sparkSession.sparkContext.broadcast((Trees(self.kind, self.features, self.classes, slim, self.middle), used))

        def outputs(v: pd.DataFrame):
            model, used = shared.value
            for lo in range(0, len(v), 1024):
                part = v.iloc[lo:lo + 1024]
                yield model, model.outputs(_columns(part, used))

        @F.pandas_udf("double")
        def prediction(v: pd.DataFrame) -> pd.Series:
            return pd.Series(np.concatenate([np.empty(0), *[m.predictions(o) for m, o in outputs(v)]]))

        @F.pandas_udf("array<double>")
        def probability(v: pd.DataFrame) -> pd.Series:
            return pd.Series([p for m, o in outputs(v) for p in m.probabilities(o)], dtype=object)

        vector = F.unwrap_udt(self.features)
        out = df.withColumn("prediction", prediction(vector))
        return out.withColumn("probability", array_to_vector(probability(vector))) if self.classes else out


def _columns(v: pd.DataFrame, used: np.ndarray) -> np.ndarray:
    """Some features of vectors given as (type, size, indices, values), as a matrix."""
    kind = v["type"].to_numpy()
    x = np.zeros((len(v), max(len(used), 1)))
    full = np.flatnonzero(kind == 1)
    if len(full) and len(used):
        x[full] = np.stack(v["values"].to_numpy()[full])[:, used]
    few = np.flatnonzero(kind == 0)
    if len(few) and len(used):
        index, value = v["indices"].to_numpy()[few], v["values"].to_numpy()[few]
        row, index, value = np.repeat(few, [len(i) for i in index]), np.concatenate(index), np.concatenate(value)
        at = np.minimum(np.searchsorted(used, index), len(used) - 1)
        kept = used[at] == index
        x[row[kept], at[kept]] = value[kept]
    return x


def _targets(y: np.ndarray, classes: int, middle: float) -> np.ndarray:
    """A number, the share of class 1 of two, or of each of more classes."""
    if not classes:
        return (y - middle)[None, :]
    return y[None, :] if classes == 2 else np.stack([y == k for k in range(classes)]).astype(float)


def _arrays(batch):
    """Sizes, kinds, indices and values of the vectors, and the labels of an Arrow batch."""
    v, y = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
    kind, indices, values = (v.field(i) for i in (0, 2, 3))
    return kind.to_numpy(zero_copy_only=False), indices.value_lengths().fill_null(0).to_numpy(), indices.flatten().to_numpy(), values.flatten().to_numpy(), y


@dataclass
class TreeEstimator:
    """``kind``: "tree", "forest" or "boosting"; ``classify``: labels are classes 0, 1, ... (two for boosting). ``mllib`` is
    MLlib's estimator, for more than a task can hold."""

    kind: str
    mllib: object
    classify: bool = False
    features: str = "features"
    label: str = "label"
    trees: int = 1
    depth: int = 5
    bins: int = 32
    step: float = 0.1
    seed: int = 42
    grid: int = field(default_factory=lambda: GRID)
    entries: int = field(default_factory=lambda: ENTRIES)

    def __post_init__(self):
        self.seed %= 1 << 63

    def __getstate__(self) -> dict:  # what tasks need
        return {k: v for k, v in self.__dict__.items() if k != "mllib"}

    def fit(self, df: DataFrame):
        y, v = F.col(self.label).cast("double"), F.unwrap_udt(self.features)
        rows = df.select(v.alias("v"), y.alias("y"))
        y = F.col("y")
        bad = y.isNull() | F.isnan(y) | F.col("v").isNull() | F.exists("v.values", lambda x: F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
        if self.classify:
            bad = bad | (y < 0) | (y != F.floor(y))
        size = F.coalesce(F.col("v.size"), F.size("v.values"))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.max("y").alias("top"), F.avg("y").alias("mean"),
                        F.max(size).alias("features"), F.sum(F.size("v.values").cast("long")).alias("held"), F.count_if(F.col("v.type") == 0).alias("sparse")).first()
        classes = max(int(seen["top"]) + 1, 2) if self.classify and seen["top"] is not None and not seen["bad"] else 0
        if not seen["n"] or seen["bad"] or (self.kind == "boosting" and classes > 2) or classes > 100:
            return self.mllib.fit(df)  # says what is wrong
        self.classes, self.middle, self.width = classes, 0.0 if classes else float(seen["mean"]), int(seen["features"])
        spark = df.sparkSession
        if seen["sparse"] and self.width > 256:
            if seen["held"] > self.entries:
                return self.mllib.fit(df)
            with _batch_rows(spark, 512):  # of long vectors
                stored = shared_table(rows.coalesce(1).mapInArrow(self._by_column(), "what int, a binary, b binary"))
            return self._from_copies(spark, stored)
        values = vector_to_array(self.features)
        n = min(seen["n"], RANKS)
        ranks = F.expr(f"cast(split('{','.join(str((i + 0.5) / n) for i in range(n))}', ',') as array<double>)")
        flat = df.select(*[values[i].alias(f"x{i}") for i in range(self.width)])
        cuts = []
        for lo in range(0, self.width, 16):
            got = flat.agg(*[F.percentile_approx(f"x{i}", ranks, 10_000) for i in range(lo, min(lo + 16, self.width))]).first()
            cuts += [find_cuts(*np.unique(np.array(q, float), return_counts=True), self.bins) for q in got]
        cells = math.prod(len(c) + 1 for c in cuts)
        targets = classes if classes > 2 else 1
        if cells * targets <= self.grid:
            return self._from_cells(rows, cuts, cells)
        if seen["n"] * (self.width + 4 * targets) > self.entries:
            return self.mllib.fit(df)
        return self._from_copies(spark, shared_table(rows.mapInArrow(self._by_row(cuts), "what int, a binary, b binary")))

    def _model(self, found: list) -> Trees:
        rows = sorted(found, key=lambda r: r["no"])
        if [r["no"] for r in rows] != list(range(1 if self.kind == "tree" else self.trees)):
            raise RuntimeError(f"{len(rows)} of {self.trees} trees came back")
        return Trees(self.kind, self.features, self.classes, [Tree.unpacked(*r[1:]) for r in rows], self.middle)

    def _part(self) -> int:
        """Features drawn for a node of a forest: the root of their number for classes, a third for numbers."""
        return math.ceil(math.sqrt(self.width)) if self.classes else math.ceil(self.width / 3)

    def _grown(self, store, y: np.ndarray, nos) -> list:
        """(number, packed tree) of rows with targets; a forest draws its rows."""
        if self.kind == "boosting":
            target = dict(y=None, ones=y[0]) if self.classes else dict(y=y[0], ones=None)
            return list(enumerate(boost(store, w=None, trees=self.trees, depth=self.depth, step=self.step, **target)))
        if self.kind == "tree":
            return [(0, self._whole(grow(store, None, y, self.depth)[0]))]
        out = []
        for no in nos:
            rng = np.random.default_rng([self.seed, no])
            w = rng.poisson(1.0, store.rows).astype(float)
            out.append((no, self._whole(grow(store, w, y * w, self.depth, self._part(), rng)[0])))
        return out

    def _whole(self, tree: Tree) -> Tree:
        return tree.merged(self.classes) if self.classes else tree

    def _from_cells(self, rows: DataFrame, cuts: list[np.ndarray], cells: int) -> Trees:
        """Sums by combination of bins, of all rows or of each tree's draws; then whole trees from them."""
        me, sizes = self, [len(c) + 1 for c in cuts]
        copies = self.trees if self.kind == "forest" else 1

        def summed(batches):
            from pyspark import TaskContext

            rng = np.random.default_rng([me.seed, TaskContext.get().partitionId()])
            weight = sums = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind, held, index, value, y = _arrays(batch)
                bins = _bins(kind, held, index, value, cuts)
                cell = np.ravel_multi_index(bins, sizes)
                target = _targets(y, me.classes, me.middle)
                if weight is None:
                    weight, sums = np.zeros((copies, cells)), np.zeros((copies, len(target), cells))
                for no in range(copies):
                    w = rng.poisson(1.0, len(y)).astype(float) if me.kind == "forest" else None
                    weight[no] += np.bincount(cell, w, cells)
                    for k, t in enumerate(target):
                        sums[no, k] += np.bincount(cell, t if w is None else t * w, cells)
            if weight is not None:
                yield from _record({"no": i, "w": weight[i].tobytes(), "s": sums[i].tobytes()} for i in range(copies))

        def grown(key, pdf):
            weight = sum(np.frombuffer(w) for w in pdf["w"])
            sums = sum(np.frombuffer(s).reshape(-1, cells) for s in pdf["s"])
            held = np.flatnonzero(weight > 0)
            if not len(held):  # a tree that drew no row
                held, weight = np.array([0]), np.where(np.arange(cells) == 0, 1.0, weight)
            store, weight, sums = Dense(list(np.unravel_index(held, sizes)), cuts), weight[held], sums[:, held]
            if me.kind == "boosting":
                target = dict(y=None, ones=sums[0]) if me.classes else dict(y=sums[0], ones=None)
                found = list(enumerate(boost(store, w=weight, trees=me.trees, depth=me.depth, step=me.step, **target)))
            else:
                part, rng = (me._part(), np.random.default_rng([me.seed, int(key[0]), 1])) if me.kind == "forest" else (None, None)
                found = [(int(key[0]), me._whole(grow(store, weight, sums, me.depth, part, rng)[0]))]
            return pd.DataFrame([(no, *t.packed()) for no, t in found], columns=["no", "feature", "cut", "left", "value"])

        part = rows.mapInArrow(summed, "no int, w binary, s binary")
        return self._model(part.groupBy("no").applyInPandas(grown, TREE).collect())

    def _from_copies(self, spark, stored: DataFrame) -> Trees:
        """Every task reads the stored columns and grows its share of the trees; a driver thread submits each task."""
        from concurrent.futures import ThreadPoolExecutor

        me = self
        tasks = min(spark.sparkContext.defaultParallelism, self.trees) if self.kind == "forest" else 1

        def grown(group: int, batches):
            got = {0: [], 1: [], 2: [], 3: []}
            for batch in batches:
                for r in batch.to_pylist():
                    got[r["what"]].append((r["a"], r["b"]))
            if got[0]:  # rows: bins and labels
                y = np.concatenate([np.frombuffer(b) for _, b in got[0]])
                parts = [np.frombuffer(a, np.uint16) for a, _ in got[0]]
                cuts = [np.frombuffer(a) for a, _ in sorted({(a, b) for a, b in got[3]}, key=lambda c: int.from_bytes(c[1], "big"))]
                width = len(cuts)
                bins = [np.concatenate([p.reshape(width, -1)[f] for p in parts]) for f in range(width)]
                del parts
                store = Dense(bins, cuts)
            elif got[2]:  # columns: bins of all features, labels and cuts
                (counts, y), (flat, sizes) = got[2][0], got[3][0]
                y, sizes = np.frombuffer(y), np.frombuffer(sizes, np.int64)
                cuts = np.split(np.frombuffer(flat), np.cumsum(sizes)[:-1])
                got[1].sort(key=lambda c: int.from_bytes(c[1], "big"))
                row = np.frombuffer(b"".join(a for a, _ in got[1]), _row_type(len(y)))
                counts = np.frombuffer(counts, np.int32)
                number = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                store = Sparse(row, number, cuts, len(y))
            else:
                return
            got.clear()
            found = me._grown(store, _targets(y, me.classes, me.middle), range(group, me.trees, tasks))
            yield from _record({"no": no, **dict(zip(("feature", "cut", "left", "value"), t.packed()))} for no, t in found)

        few = spark.newSession()  # with a setting of its own: a row holds a few MB
        few.conf.set(BATCH, "1")
        rows = few.read.schema(stored.schema).parquet(stored._shared_path).coalesce(1)

        def run(group: int) -> list:
            return rows.mapInArrow(partial(grown, group), TREE).collect()

        with ThreadPoolExecutor(max_workers=tasks) as pool:
            model = self._model([r for rows in pool.map(run, range(tasks)) for r in rows])
        drop_shared(stored)
        return model

    def _by_row(self, cuts: list[np.ndarray]):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    kind, held, index, value, y = _arrays(batch)
                    yield from _record([{"what": 0, "a": np.stack(_bins(kind, held, index, value, cuts)).astype(np.uint16).tobytes(), "b": y.tobytes()}])
                    yield from _record({"what": 3, "a": c.tobytes(), "b": i.to_bytes(4, "big")} for i, c in enumerate(cuts))

        return run

    def _by_column(self):
        width, bins = self.width, self.bins

        def run(batches):
            sizes, indices, values, labels = [], [], [], []
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind, held, index, value, y = _arrays(batch)
                if (kind == 1).any():
                    held, index, value = _thinned(kind, held, index, value, width)
                kept = value != 0
                row = np.repeat(np.arange(len(y)), held)
                sizes.append(np.bincount(row[kept], minlength=len(y)))
                indices.append(index[kept].astype(np.uint16 if width <= 65536 else np.int32))
                values.append(value[kept])
                labels.append(y)
            if not labels:
                return
            y, size, index, value = (np.concatenate(x) for x in (labels, sizes, indices, values))
            del indices, values
            order = np.argsort(index, kind="stable")
            row = np.repeat(np.arange(len(y), dtype=np.int32), size)[order]
            value = value[order]
            ends = np.searchsorted(index[order], np.arange(width + 1))
            del index, order
            cuts, counts, kept = [], [], []

            def chunk(no: int):
                yield from _record([{"what": 1, "a": np.concatenate(kept).astype(_row_type(len(y))).tobytes(), "b": no.to_bytes(4, "big")}])
                kept.clear()

            for f in range(width):
                x, r = value[ends[f]:ends[f + 1]], row[ends[f]:ends[f + 1]]
                distinct, count = np.unique(x, return_counts=True)
                zeros = len(y) - len(x)
                if zeros:
                    at = np.searchsorted(distinct, 0.0)
                    distinct, count = np.insert(distinct, at, 0.0), np.insert(count, at, zeros)
                    if at:  # zero is not the lowest value: its rows are written out
                        r = np.r_[r, np.setdiff1d(np.arange(len(y), dtype=np.int32), r)]
                        x = np.r_[x, np.zeros(len(r) - len(x))]
                c = find_cuts(distinct, count, bins)
                cuts.append(c)
                b = np.searchsorted(c, x, side="left")
                o = np.argsort(b, kind="stable")
                o = o[b[o] > 0]
                kept.append(r[o])
                counts.append(np.bincount(b, minlength=len(c) + 1)[1:].astype(np.int32))
                if sum(map(len, kept)) >= STEP:
                    yield from chunk(f)
            if kept:
                yield from chunk(width)
            yield from _record([{"what": 2, "a": np.concatenate(counts).tobytes(), "b": y.tobytes()},
                                {"what": 3, "a": np.concatenate(cuts).tobytes(), "b": np.array([len(c) for c in cuts], np.int64).tobytes()}])

        return run


_setting = Lock()


@contextmanager
def _batch_rows(spark, rows: int):
    """Rows of an Arrow batch meanwhile."""
    with _setting:
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, str(rows))
        try:
            yield
        finally:
            spark.conf.set(BATCH, before)


def _row_type(rows: int):
    return np.uint16 if rows <= 65536 else np.int32


def _thinned(kind, held, index, value, width):
    """Vectors of both kinds as indices and values."""
    sizes = np.where(kind == 1, width, held)
    out, i, v = np.empty(sizes.sum(), np.int64), 0, 0
    at = np.r_[0, np.cumsum(sizes)]
    for no, (k, n) in enumerate(zip(kind, sizes)):
        out[at[no]:at[no + 1]] = np.arange(width) if k == 1 else index[i:i + n]
        i += 0 if k == 1 else n
    return sizes, out, value


def _bins(kind, held, index, value, cuts) -> list[np.ndarray]:
    """Bins of each feature, from vectors of either kind."""
    width = len(cuts)
    if (kind == 1).all():
        x = value.reshape(-1, width)
    else:
        sizes, index, value = _thinned(kind, held, index, value, width)
        x = np.zeros((len(kind), width))
        x[np.repeat(np.arange(len(kind)), sizes), index] = value
    return [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]


def _record(rows):
    """An Arrow batch for each row: a batch's binary column holds less than 2 GB."""
    import pyarrow as pa

    for r in rows:
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in r.items()})
