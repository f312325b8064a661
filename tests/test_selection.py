"""Grouped selection, folds, learning curves, neighbours in two rounds, sparse online updates, penalties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import features, models, neighbors, online


def expected_flags(rows, frac):
    """rows: (label, key, hash); the first ceil(frac * n) by (hash, key) of each label."""
    out = {}
    for label in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == label), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            out[r[1]] = int(i < math.ceil(frac * len(mine)))
    return out


@pytest.mark.parametrize("sql_hash", [True, False])
@pytest.mark.parametrize("frac", [0.2, 0.5, 0.999, 0.0])
def test_split_takes_the_first_of_every_class(spark, sql_hash, frac):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 5).cast("string")))
    h = features.split_order(["id"], 42, sql_hash)
    rows = [(r["label"], r["id"], r["h"]) for r in df.withColumn("h", h).collect()]
    out = features.stratified_split(df, "label", ["id"], frac, sql_hash=sql_hash)
    assert out.columns == ["id", "label", "is_test"]
    assert {r["id"]: r["is_test"] for r in out.collect()} == expected_flags(rows, frac)


def test_a_hundred_thousand_classes(spark):
    df = spark.range(400_000).withColumn("label", (F.col("id") % 100_000)).withColumn("wide", F.repeat(F.lit("x"), 50))
    out = features.stratified_split(df, "label", ["id"], 0.25)
    per = out.groupBy("label").agg(F.sum("is_test").alias("n"), F.count("*").alias("all"))
    assert per.where("n = 1 and all = 4").count() == 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortMergeJoin", "") and "rangepartitioning" not in plan


def test_rows_that_tie_on_the_cut(spark):
    df = spark.createDataFrame([("a", 1)] * 6 + [("a", 2)] * 3 + [(None, 1)] * 5, "label string, k int")
    out = features.stratified_split(df, "label", ["k"], 0.5)
    assert {r["label"]: (r["n"], r["all"]) for r in out.groupBy("label").agg(F.sum("is_test").alias("n"), F.count("*").alias("all")).collect()} == {
        "a": (5, 9), None: (3, 5)}


def test_folds_are_even_and_repeatable(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 3).cast("int"))
    out = features.stratified_folds(df, "label", ["id"], 5)
    sizes = [r["n"] for r in out.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 15 and max(sizes) - min(sizes) <= 1
    again = features.stratified_folds(df.repartition(11), "label", ["id"], 5)
    assert out.join(again.withColumnRenamed("fold", "f2"), "id").where("fold <> f2").count() == 0


def _points(spark, n=400):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(n).withColumn("label", (F.col("id") * 7919 % 11 > F.col("id") % 5 + 2).cast("int"))
    return df.withColumn("features", array_to_vector(F.array((F.col("id") % 5).cast("double"), (F.col("id") * 31 % 17).cast("double"))))


def test_curves_side_by_side_equal_one_after_another(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    data = _points(spark)
    kinds = {"logistic": LogisticRegression(maxIter=5), "tree": DecisionTreeClassifier(maxDepth=3, seed=1)}
    at_once = models.learning_curves(data, kinds, folds=2, sizes=(0.3, 1.0), at_once=6).collect()
    in_turn = models.learning_curves(data, kinds, folds=2, sizes=(0.3, 1.0), at_once=1).collect()
    assert at_once == in_turn and [r["model"] for r in at_once] == ["logistic"] * 2 + ["tree"] * 2
    assert at_once[1]["train_size"] == 200
    alone = models.learning_curve(data, kinds["tree"], folds=2, sizes=(0.3, 1.0)).collect()
    assert [r["validation_accuracy"] for r in alone] == [r["validation_accuracy"] for r in at_once[2:]]


def test_linear_classifiers_carry_their_penalty(spark):
    from pyspark.ml.classification import LogisticRegression

    data = _points(spark)
    fitted, _ = models.fit_all({"l": LogisticRegression(maxIter=500, tol=1e-12)}, data)
    w, b = np.array(fitted["l"].coefficients), fitted["l"].intercept
    x = np.array([r["features"].toArray() for r in data.collect()])
    y = np.array([1.0 if r["label"] else -1.0 for r in data.collect()])
    pull = -y / (1 + np.exp(y * (x @ w + b)))
    assert np.abs(w + x.T @ pull).max() < 1e-3 and abs(pull.sum()) < 1e-3  # gradient of |w|^2 / 2 + sum of losses
    assert models.penalised("other", 5) == "other"


def brute(train, query, k):
    out = {}
    for qid, q in query:
        near = sorted((float(((np.array(q) - np.array(v)) ** 2).sum()), i) for i, v in train)
        out[qid] = [i for _, i in near[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    r = np.random.default_rng(5)
    train = [(i, r.normal(size=3).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    odd = [(5000, None), (5001, [float("nan"), 0.0, 0.0]), (5002, [float("inf"), 0.0, 0.0]), (5003, [None, 0.0, 0.0]), (5004, [])]
    query = [(i, r.normal(size=3).round(1).tolist()) for i in range(60)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(50)]
    t = spark.createDataFrame([(i, v, i % 3) for i, v in train + odd], "id long, v array<double>, label int").repartition(4)
    q = spark.createDataFrame(query + odd, "id long, v array<double>")
    found = neighbors.nearest(t, q, 4, "v", "id", "label", pivots=9, block_rows=16)
    got = {}
    for row in found.orderBy("query_id", "dist2", "neighbor_id").collect():
        got.setdefault(row["query_id"], []).append(row["neighbor_id"])
    assert got == brute(train, query, 4)
    assert neighbors.nearest(t.limit(0), q, 4, "v", "id", "label").count() == 0
    assert neighbors.nearest(t, q.limit(0), 4, "v", "id", "label").count() == 0
    few = neighbors.nearest(t.where("id < 3"), q, 5, "v", "id", "label")
    assert few.groupBy("query_id").count().where("count <> 3").count() == 0


def test_training_rows_go_only_where_a_query_visits(spark):
    def shuffled(n):
        r = np.random.default_rng(n)
        centres = np.random.default_rng(0).normal(size=(40, 4)) * 100
        rows = [(i, (centres[i % 40] + r.normal(size=4)).tolist(), 0.0) for i in range(n)]
        t = spark.createDataFrame(rows, "id long, v array<double>, label double")
        cells = neighbors.Cells(t, 5, 64, 200)
        asked = cells.locate(t.select((F.col("id") + 10**6).alias("id"), "v"))
        visits = asked.withColumn("cell", F.explode("cells")).drop("cells")
        return neighbors.meetings(cells.held, visits, cells.parts).count()

    small, large = shuffled(2000), shuffled(8000)
    assert large < 4 * small * 1.6  # in proportion to the rows, not to rows x queries
    assert large < 8000 * 12


def dense_epochs(rows, dim, loss, epochs, alpha=1e-4, c=1.0):
    w, b, t, t0 = np.zeros(dim), 0.0, 1.0, 1.0 / alpha
    for _ in range(epochs):
        for idx, val, y01 in rows:
            y = 1.0 if y01 > 0 else -1.0
            val = np.array(val)
            margin = w[idx] @ val + b
            if loss == "log":
                eta = 1.0 / (alpha * (t0 + t))
                g = -y / (1.0 + np.exp(y * margin))
                w *= 1.0 - eta * alpha
                w[idx] -= eta * g * val
                b -= eta * g
            elif loss == "perceptron":
                if y * margin <= 0:
                    w[idx] += y * val
                    b += y
            else:
                short = max(0.0, 1.0 - y * margin)
                tau = min(c, short / (val @ val + 1.0)) if short > 0 else 0.0
                w[idx] += tau * y * val
                b += tau * y
            t += 1
    return w, b


@pytest.mark.parametrize("loss", online.LOSSES)
def test_sparse_updates_equal_dense_ones(spark, loss):
    r = np.random.default_rng(8)
    rows = []
    for _ in range(80):
        idx = sorted(r.choice(50, 6, replace=False).tolist())
        rows.append((idx, r.normal(size=6).tolist(), int(r.integers(2))))
    df = spark.createDataFrame(rows, "indices array<int>, `values` array<double>, label int").coalesce(1)
    w, b = online.fit_online(df, 50, loss=loss, epochs=3, tol=-np.inf)
    want_w, want_b = dense_epochs(rows, 50, loss, 3)
    assert np.abs(w - want_w).max() < 1e-9 and abs(b - want_b) < 1e-9


def test_online_losses_learn_side_by_side_from_rows_read_once(spark):
    r = np.random.default_rng(9)
    rows = [(sorted(r.choice(30, 4, replace=False).tolist()), r.normal(size=4).tolist(), [0, 1, None][i % 3]) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "indices array<int>, `values` array<double>, label int").coalesce(1)
    df = df.mapInPandas(count, df.schema)
    together = online.fit_online_losses(df, 30, epochs=4, tol=-np.inf)
    assert seen.value == 60  # not once for each epoch and loss
    for loss, (w, b) in together.items():
        want_w, want_b = dense_epochs([(i, v, y or 0) for i, v, y in rows], 30, loss, 4)
        assert np.abs(w - want_w).max() < 1e-9 and abs(b - want_b) < 1e-9
