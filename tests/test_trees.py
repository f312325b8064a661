"""Trees over binned features: the same trees as MLlib's, whichever way the rows go, and none left out."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from shelfwise.operators import models, trees

# summed by combination of bins, or whole copies for each task
CELLS, COPIES = {"grid": 1 << 30}, {"grid": 0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, 20, 1500).astype(float), rng.normal(size=1500).round(2), rng.integers(-3, 4, 1500).astype(float)
    y = a * 3 + np.sin(b * 3) * 10 + c * b + rng.normal(size=1500)
    two, three = (y > y.mean()).astype(float), np.digitize(y, np.quantile(y, [0.3, 0.7])).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, two, three)], "a double, b double, c double, y double, two double, three double")
    return models.right_size(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(3)))


def _fit(estimator, df, **limits):
    mine = models.binned_trees(estimator)
    for k, v in limits.items():
        setattr(mine, k, v)
    return mine.fit(df)


@pytest.mark.parametrize("way", [CELLS, COPIES])
@pytest.mark.parametrize("kind,settings", [
    (DecisionTreeRegressor, dict(maxDepth=30, maxBins=64, labelCol="y")),
    (DecisionTreeClassifier, dict(maxDepth=6, maxBins=64, labelCol="two")),
    (DecisionTreeClassifier, dict(maxDepth=6, maxBins=64, labelCol="three")),
    (GBTRegressor, dict(maxIter=10, maxDepth=4, stepSize=0.3, labelCol="y")),
    (GBTClassifier, dict(maxIter=10, maxDepth=4, stepSize=0.3, labelCol="two")),
])
def test_the_trees_are_mllibs(spark, rows, kind, settings, way):
    estimator = kind(**settings)
    theirs = estimator.fit(rows).transform(rows).withColumnRenamed("prediction", "p").withColumnRenamed("probability", "q").drop("rawPrediction")
    model = _fit(estimator, rows, **way)
    assert isinstance(model, trees.Trees)
    both = model.transform(theirs).toPandas()
    assert np.abs(both["p"] - both["prediction"]).max() < 1e-9
    if "q" in both:
        assert max(np.abs(q.toArray() - p.toArray()).max() for q, p in zip(both["q"], both["probability"])) < 1e-9


@pytest.mark.parametrize("way", [CELLS, COPIES])
def test_a_forest_has_all_its_trees(spark, rows, way):
    theirs = RandomForestRegressor(numTrees=40, maxDepth=6, labelCol="y", seed=1).fit(rows)
    model = _fit(RandomForestRegressor(numTrees=40, maxDepth=6, labelCol="y", seed=1), rows, **way)
    assert len(model.trees) == 40 and len({t.cut.tobytes() for t in model.trees}) == 40
    assert {int(t.feature[0]) for t in model.trees} == {0, 1, 2}  # one of three features is drawn for a node
    error = [m.transform(rows).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] for m in (theirs, model)]
    assert 0.5 * error[0] < error[1] < 2 * error[0]
    again = _fit(RandomForestRegressor(numTrees=40, maxDepth=6, labelCol="y", seed=1), rows, **way)
    assert [t.cut.tobytes() for t in again.trees] == [t.cut.tobytes() for t in model.trees]
    # about as many rows as there are, drawn with replacement: the roots' means differ
    assert len({round(float(t.value[0][0]), 9) for t in model.trees}) == 40


def _sparse_rows(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((600, 300)) < 0.05, rng.random((600, 300)).round(2), 0.0)
    x[:, 1] = np.where(rng.random(600) < 0.5, -rng.random(600).round(1), 0.0)  # zero is not the lowest
    y = (x[:, :6].sum(axis=1) + rng.normal(size=600) * 0.1 > 0.2).astype(float)
    data = [(i, float(v), Vectors.dense(r) if i % 7 == 0 else Vectors.sparse(300, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist())) for i, (r, v) in enumerate(zip(x, y))]
    return models.right_size(spark.createDataFrame(data, ["id", "label", "features"]).repartition(2))


def test_sparse_vectors(spark, monkeypatch):
    df = _sparse_rows(spark)
    for estimator in (DecisionTreeClassifier(maxDepth=8), GBTClassifier(maxIter=3, maxDepth=4, stepSize=0.3)):
        theirs = estimator.fit(df).transform(df).select("id", F.col("prediction").alias("p"))
        model = _fit(estimator, df)
        assert isinstance(model, trees.Trees)
        assert model.transform(df).join(theirs, "id").where("prediction = p").count() >= 598  # two cuts may gain the same
    forest = _fit(RandomForestClassifier(numTrees=20, maxDepth=8), df)
    assert len(forest.trees) == 20
    right = forest.transform(df).where("prediction = label").count()
    assert right >= 540
    assert spark.conf.get(trees.BATCH) == "10000"


def test_sparse_and_dense_stores_agree():
    rng = np.random.default_rng(2)
    x = np.where(rng.random((900, 60)) < 0.1, rng.random((900, 60)).round(2), 0.0)
    y = (x[:, :6].sum(axis=1) + rng.normal(size=900) * 0.1 > 0.2).astype(float)
    cuts = [trees.find_cuts(*np.unique(x[:, f], return_counts=True), 32) for f in range(60)]
    bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    starts = np.r_[0, np.cumsum([len(c) for c in cuts])]
    order = [[r for r in np.argsort(b, kind="stable") if b[r] > 0] for b in bins]
    row, number = np.concatenate(order).astype(np.int32), np.concatenate([starts[f] + bins[f][o] - 1 for f, o in enumerate(order)]).astype(np.int32)
    dense, sparse = trees.Dense(bins, cuts), trees.Sparse(row, number, cuts, 900)
    w = rng.poisson(1, 900).astype(float)
    for weight, part, depth in ((None, None, 6), (None, None, 30), (w, 8, 12), (w, 40, 12)):
        target = y[None, :] * (1.0 if weight is None else weight)
        (a, la), (b, lb) = (trees.grow(s, weight, target, depth, part, np.random.default_rng(3)) for s in (dense, sparse))
        assert np.array_equal(a.cut, b.cut) and np.array_equal(la, lb)
        inside = np.ones(900, bool) if weight is None else weight > 0
        assert np.array_equal(a.leaves(x)[inside], la[inside])


def test_many_nodes_take_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)).round(1)
    cuts = [trees.find_cuts(*np.unique(x[:, f], return_counts=True), 32) for f in range(3)]
    store, y = trees.Dense([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], cuts), rng.integers(0, 1000, (1, 2000)).astype(float)
    a, _ = trees.grow(store, None, y, 30)
    monkeypatch.setattr(trees, "STEP", 1)
    b, _ = trees.grow(store, None, y, 30)
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut)


def test_wrong_rows_are_told(spark, rows):
    from pyspark.errors import PySparkException

    estimator = models.binned_trees(DecisionTreeRegressor(labelCol="y"))
    with pytest.raises(PySparkException):
        estimator.fit(rows.withColumn("y", F.when(F.col("a") > 3, F.col("y")))).transform(rows).count()


def test_one_class_and_one_value(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(50).select(F.lit(1.0).alias("x"), F.lit(0).alias("label")))
    for name in ("DecisionTree", "RandomForest", "GradientBoosting"):
        model = models.classifiers(trees=3)[name].fit(df)
        assert model.transform(df).select("prediction").distinct().collect() == [(0.0,)]
    own = models.regressors(trees=3)["RandomForest"].fit(df).transform(df).select("prediction").distinct().collect()
    assert own == [(0.0,)]


def test_more_than_a_task_holds_goes_to_mllib(spark, rows):
    assert not isinstance(_fit(DecisionTreeRegressor(labelCol="y"), rows, grid=0, entries=10), trees.Trees)


def test_boards_do_not_pass_over_the_rows_for_each_level(spark, rows):
    """A boosted fit took hundreds of jobs, one a level; now a few."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosted-fit", "jobs of one fit")
    try:
        models.regressors(trees=30, boost_depth=3, label="y")["GradientBoosting"].fit(rows)
        assert len(tracker.getJobIdsForGroup("boosted-fit")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fits_side_by_side(spark, rows):
    kinds = {k: v for k, v in models.regressors(trees=3, label="y").items() if k != "RandomForest"}
    one, _ = models.fit_all(kinds, rows)
    many, times = models.fit_all(kinds, rows, at_once=3)
    assert list(one) == list(many) == list(times)
    boards = [[tuple(r) for r in models.regression_leaderboard(m, rows, "y").collect()] for m in (one, many)]
    assert boards[0] == boards[1]
