"""Regularised second-order gradient boosting (M4, M5, M7) as Spark aggregates.

Features become bins at quantiles once. A tree grows level by level: one aggregate sums
gradient and curvature by (node, feature, bin) for all nodes of the level, running sums over the bins give
every split's gain ``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)``, and the best split of each node (at most
``2 ** level`` rows) comes to the driver. Rows find their node by array look-ups, so they are never
moved; their margins are written anew every few trees, which cuts the lineage. The sums are partial in
the tasks first: what is shuffled is nodes x features x bins a task, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.stats import exact_quantiles_by
from shelfwise.session import drop_shared, shared_table

#: Trees whose margins are kept as expressions before the rows are written anew.
KEPT_TREES = 5


@dataclass
class Tree:
    """A binary tree by node number (root 1, children ``2 n`` and ``2 n + 1``): a split's feature (-1: leaf), last bin of its
    left side and gain; a leaf's value; rows of each node."""

    feature: dict[int, int] = field(default_factory=dict)
    bin: dict[int, int] = field(default_factory=dict)
    gain: dict[int, float] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def table(self, what: dict, missing, size: int) -> list:
        return [what.get(n, missing) for n in range(size)]

    def node(self, levels: int) -> Column:
        """The node of a row with column ``bins`` after so many levels."""
        if not levels:
            return F.lit(1)
        size = 1 << levels
        feature, last = F.lit(self.table(self.feature, -1, size)), F.lit(self.table(self.bin, 0, size))

        def step(n: Column, _: Column) -> Column:  # a fold: the node stands in it once, not once for each use at each level
            f = F.coalesce(F.get(feature, n), F.lit(-1))
            right = (F.get(F.col("bins"), F.greatest(f, F.lit(0))) > F.get(last, n)).cast("int")
            return F.when(f < 0, n).otherwise(2 * n + right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)

    def margin(self, depth: int) -> Column:
        return F.coalesce(F.get(F.lit(self.table(self.value, 0.0, 2 << depth)), self.node(depth)), F.lit(0.0))


@dataclass
class Boosted:
    """Fitted trees; ``transform`` adds ``prediction`` (and ``probability_1`` for classes 0 and 1)."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    depth: int
    classify: bool
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, np.where(np.isnan(v), -np.inf, v), side="left") for c, v in zip(self.cuts, x.T)], axis=1)
        out = np.full(len(x), self.base)
        size = 2 << self.depth
        for t in self.trees:
            feature, last = np.array(t.table(t.feature, -1, size)), np.array(t.table(t.bin, 0, size))
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = bins[np.arange(len(x)), np.maximum(f, 0)] > last[node]
                node = np.where(f < 0, node, 2 * node + right)
            out += np.array(t.table(t.value, 0.0, size))[node]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def margin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
                yield pd.Series(model.margins(x))

        out = df.withColumn("_margin", margin(*[F.col(c).cast("double") for c in self.features]))
        if not self.classify:
            return out.withColumnRenamed("_margin", "prediction")
        out = out.withColumn("probability_1", 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")
        return out.withColumn("prediction", (F.col("probability_1") > 0.5).cast("double"))

    def nodes(self, spark) -> DataFrame:
        """(tree, node, feature, cut, gain, value, rows): every split and every leaf."""
        rows = []
        for no, t in enumerate(self.trees):
            for n in sorted(t.rows):
                f = t.feature.get(n, -1)
                split = (self.features[f], float(self.cuts[f][t.bin[n]]), float(t.gain[n]), None) if f >= 0 else (None, None, None, float(t.value[n]))
                rows.append((no, n, *split, int(t.rows[n])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, gain double, value double, rows long")


def _binned(df: DataFrame, features: list[str], cuts: list[list[float]]) -> Column:
    """Bin of each feature: how many cuts lie below the value (missing values: the first bin)."""
    def one(c: str, ends: list[float]) -> Column:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        return F.size(F.filter(F.lit(ends), lambda e: e < x)) if ends else F.lit(0)

    return F.array(*[one(c, ends) for c, ends in zip(features, cuts)])


def _grow(rows: DataFrame, g: Column, h: Column, depth: int, penalty: float, least_curvature: float, step: float) -> Tree:
    tree, active = Tree(), [1]
    by_bin = Window.partitionBy("node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("node", "f")
    for level in range(depth):
        live = F.coalesce(F.get(F.lit([n in set(active) for n in range(2 << level)]), F.col("node")), F.lit(False))
        mine = rows.select(tree.node(level).alias("node"), g.alias("g"), h.alias("h"), "bins").where(live)
        hist = mine.select("node", "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
        sums = hist.select("node", "f", "bin", *[F.sum(c).over(by_bin).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(f"{c}a") for c in "ghn"])
        gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
        gain = F.col("gl") ** 2 / (F.col("hl") + penalty) + gr**2 / (hr + penalty) - F.col("ga") ** 2 / (F.col("ha") + penalty)
        fits = (F.col("na") > F.col("nl")) & (F.col("hl") >= least_curvature) & (hr >= least_curvature)
        gain = F.when(fits & (gain > 0), gain)
        best = sums.withColumn("gain", gain).groupBy("node").agg(
            F.max_by(F.struct("f", "bin", "gain", "gl", "hl", "nl"), F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("f"), -F.col("bin")))).alias("b"),
            F.first("ga").alias("ga"), F.first("ha").alias("ha"), F.first("na").alias("na"))
        found, active = best.collect(), []  # a row for each node of the level
        for r in found:
            n, b = r["node"], r["b"]
            tree.rows[n] = r["na"]
            if b is None:
                tree.value[n] = -r["ga"] / (r["ha"] + penalty) * step
                continue
            tree.value.pop(n, None)
            tree.feature[n], tree.bin[n], tree.gain[n] = b["f"], b["bin"], b["gain"]
            for child, cg, ch, cn in ((2 * n, b["gl"], b["hl"], b["nl"]), (2 * n + 1, r["ga"] - b["gl"], r["ha"] - b["hl"], r["na"] - b["nl"])):
                tree.value[child], tree.rows[child] = -cg / (ch + penalty) * step, cn
                active.append(child)
        if not active:
            break
    return tree


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", classify: bool = False, trees: int = 100, depth: int = 6,
                step: float = 0.3, penalty: float = 1.0, bins: int = 256, least_curvature: float = 1.0, exact: bool = False) -> Boosted:
    """M4/M5/M7: boosted trees for a number or, with ``classify``, for classes 0 and 1 (logistic loss).

    ``penalty``: on the squares of the leaves' values; ``least_curvature``: a side with less is not split off. The
    base is the label's mean (its log odds). Rows without a label are left out; missing features sort first. The
    cuts between bins are values near the quantiles, from one sketch of all features (a rank is off by a
    ten-thousandth of the rows at most), or with ``exact`` the interpolated quantiles themselves (for few bins).
    """
    y = F.col(label).cast("double")
    df = shared_table(df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])]))
    shares = [i / bins for i in range(1, bins)]
    values = [F.col(f"`{c}`").cast("double") for c in features]
    sketches = [] if exact else [F.percentile_approx(F.when(~F.isnan(v), v), shares, 10_000).alias(f"q{i}") for i, v in enumerate(values)]
    seen = df.agg(F.avg(y).alias("mean"), *sketches).first()
    mean = seen["mean"]
    if mean is None:
        raise ValueError("no row has a label")
    found = exact_quantiles_by(df, dict.fromkeys(features, shares)) if exact else {c: seen[f"q{i}"] or [] for i, c in enumerate(features)}
    cuts = [sorted({q for q in found[c] if q is not None}) for c in features]
    base = math.log(max(mean, 1e-12) / max(1 - mean, 1e-12)) if classify else float(mean)
    model = Boosted(features, cuts, base, depth, classify)
    rows = shared_table(df.select(_binned(df, features, cuts).alias("bins"), y.alias("y"), F.lit(base).alias("m")))
    drop_shared(df)
    stored = rows
    for no in range(trees):
        p = 1 / (1 + F.exp(-F.col("m")))
        g, h = (p - F.col("y"), p * (1 - p)) if classify else (F.col("m") - F.col("y"), F.lit(1.0))
        tree = _grow(rows, g, h, depth, penalty, least_curvature, step)
        model.trees.append(tree)
        rows = rows.withColumn("m", F.col("m") + tree.margin(depth))
        if (no + 1) % KEPT_TREES == 0:
            rows, spent = shared_table(rows), stored
            stored = rows
            drop_shared(spent)
    drop_shared(stored)
    return model


@dataclass
class BoostedVectors:
    """The trees over the entries of a dense vector column; ``transform`` as that of :class:`Boosted`."""

    model: Boosted
    vector: str

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_entries(df.drop("prediction", "probability_1"), self.vector, len(self.model.features)))
        return out.drop(*self.model.features)


def _entries(df: DataFrame, vector: str, width: int) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array(vector)
    return df.withColumns({f"_x{i}": values[i] for i in range(width)})


@dataclass
class SecondOrderBoosting:
    """:func:`fit_boosted` with an estimator's ``fit``, for the model boards: features are a dense vector column."""

    features: str = "features"
    label: str = "label"
    classify: bool = False
    trees: int = 100
    depth: int = 6
    step: float = 0.3
    penalty: float = 1.0
    bins: int = 256

    def fit(self, df: DataFrame) -> BoostedVectors:
        one = df.select(self.features).first()
        if one is None:
            raise ValueError("no rows to fit")
        names = [f"_x{i}" for i in range(len(one[0]))]
        rows = _entries(df.select(self.features, self.label), self.features, len(names))
        return BoostedVectors(fit_boosted(rows, names, self.label, self.classify, self.trees, self.depth, self.step, self.penalty, self.bins), self.features)
