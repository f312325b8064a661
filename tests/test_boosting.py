"""Boosted trees against a plain version that tries every split of every node."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators.boosting import fit_boosted


def plain_fit(x, y, classify, trees, depth, step, penalty, bins, least):
    n = len(x)
    clean = np.where(np.isnan(x), -np.inf, x)
    cuts = [sorted(set(np.quantile(v[~np.isnan(v)], [i / bins for i in range(1, bins)]).tolist())) for v in x.T]
    b = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, clean.T)], axis=1)
    m = np.full(n, math.log(y.mean() / (1 - y.mean())) if classify else y.mean())
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = (p - y, p * (1 - p)) if classify else (m - y, np.ones(n))
        node = np.ones(n, int)
        for _ in range(depth):
            new = node.copy()
            for k in np.unique(node):
                at = node == k
                score = lambda s: g[s].sum() ** 2 / (h[s].sum() + penalty)
                best = None
                for f in range(x.shape[1]):
                    for e in range(len(cuts[f])):
                        left, right = at & (b[:, f] <= e), at & (b[:, f] > e)
                        if left.any() and right.any() and h[left].sum() >= least and h[right].sum() >= least:
                            gain = score(left) + score(right) - score(at)
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, e)
                if best:
                    new[at] = 2 * k + (b[at, best[1]] > best[2])
            if (new == node).all():
                break
            node = new
        for k in np.unique(node):
            at = node == k
            m[at] += -g[at].sum() / (h[at].sum() + penalty) * step
        out.append(node)
    return m


@pytest.mark.parametrize("classify", [False, True])
def test_against_every_split(spark, classify):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3)).round(2)
    x[::17, 1] = np.nan
    y = np.where(x[:, 0] > 0.3, 3.0, 1.0) + np.nan_to_num(x[:, 1]) * (x[:, 2] > 0) + r.normal(0, 0.2, 400)
    y = (y > 2).astype(float) if classify else y
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))] + [(999, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, label double").repartition(3)
    model = fit_boosted(df, ["a", "b", "c"], classify=classify, trees=3, depth=3, bins=10, exact=True)
    got = np.array([r["v"] for r in model.transform(df.where("i < 999")).orderBy("i").select(F.col("probability_1" if classify else "prediction").alias("v")).collect()])
    want = plain_fit(x, y, classify, 3, 3, 0.3, 1.0, 10, 1.0)
    want = 1 / (1 + np.exp(-want)) if classify else want
    assert np.abs(got - want).max() < 1e-9


def test_it_learns_and_stops_where_nothing_is_gained(spark):
    df = spark.range(600).select((F.col("id") % 30).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    df = df.withColumn("label", F.when(F.col("x") > 14, 10.0).otherwise(2.0))
    model = fit_boosted(df, ["x", "none"], trees=12, depth=4, bins=32)
    error = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("label"))).alias("e")).first()["e"]
    assert error < 0.2
    nodes = model.nodes(spark)
    assert nodes.where("tree = 0 and feature is not null").count() == 1  # one split tells all
    assert nodes.where("feature is null").groupBy("tree").agg(F.sum("rows").alias("n")).where("n <> 600").count() == 0
    flat = fit_boosted(df.withColumn("label", F.lit(5.0)), ["x"], trees=1, depth=3)
    assert flat.nodes(spark).select("node", "value", "rows").collect() == [(1, 0.0, 600)]
    with pytest.raises(ValueError):
        fit_boosted(df.limit(0), ["x"])


def test_on_the_boards(spark):
    from pyspark.ml.feature import VectorAssembler

    from shelfwise.operators import models

    df = spark.range(300).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("label", (F.col("x") > 9).cast("int"))
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    kinds = {k: v for k, v in models.classifiers(trees=3, second_order=True).items() if k in ("SecondOrderBoosting", "DecisionTree")}
    fitted, _ = models.fit_all(kinds, df)
    board = {r["model"]: r["accuracy"] for r in models.classification_leaderboard(fitted, df).collect()}
    assert board == {"SecondOrderBoosting": 1.0, "DecisionTree": 1.0}
    one = models.score(fitted["SecondOrderBoosting"], df.limit(1)).first()
    assert one["outcome"] == models.UNLIKELY and one["probability_1"] < 0.5
