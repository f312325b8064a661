"""Models as Spark jobs.

MLlib estimators train distributed over the executors; evaluation uses the
aggregate metrics of ``shelfwise.operators.metrics``. Tree and boosting
details differ from other libraries, so the contract is the task and the
metric, not identical numbers.
"""

from __future__ import annotations

import time

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.boosting import SecondOrderBoosting
from shelfwise.operators.clean import standardize
from shelfwise.operators.metrics import classification_metrics, confusion_counts, hard_vote, regression_metrics
from shelfwise.operators.trees import TreeEstimator
from shelfwise.session import drop_shared, shared_table

SEED = 42


#: Rows from which on a training set is worth a further task.
TASK_ROWS = 5_000
#: The same for each of many small fits that run at once: a pass over fewer rows takes less than its task's start.
CURVE_TASK_ROWS = 10_000


def right_size(df: DataFrame) -> DataFrame:
    """The training set written once in the shared folder and read back: what feeds it runs once, with its own partitions,
    and nothing is left in the executors' memory. Few bytes often are many rows (a narrow table comes back as one
    file, one task), so a set that one task would read most of is written again in even parts, as many
    as the cluster has cores, with at least ``TASK_ROWS`` rows each."""
    stored = shared_table(df)
    sizes = [r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect()]  # a row a task
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // TASK_ROWS))
    if parts < 2 or max(sizes) * parts <= 2 * sum(sizes):
        return stored
    even = shared_table(stored.repartition(parts))
    drop_shared(stored)
    return even


def binned_trees(estimator) -> TreeEstimator:
    """The same trees by :mod:`shelfwise.operators.trees`, with ``estimator``'s settings; it is fitted itself where rows are too many for that."""
    e = estimator
    given = dict(classify=isinstance(e, (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)), features=e.getFeaturesCol(), label=e.getLabelCol(),
                 depth=e.getMaxDepth(), bins=e.getMaxBins(), seed=e.getSeed())
    if isinstance(e, (GBTClassifier, GBTRegressor)):
        return TreeEstimator("boosting", e, trees=e.getMaxIter(), step=e.getStepSize(), **given)
    if isinstance(e, (RandomForestClassifier, RandomForestRegressor)):
        return TreeEstimator("forest", e, trees=e.getNumTrees(), **given)
    return TreeEstimator("tree", e, **given)


def regressors(features: str = "features", label: str = "label", trees: int = 100, tree_depth: int = 30,
               forest_depth: int = 12, boost_depth: int = 6, step: float = 0.3, second_order: bool = False) -> dict:
    """M4: linear, tree, forest and boosted regressors; ``second_order`` adds boosting with curvature and a penalty on the leaves."""
    common = {"featuresCol": features, "labelCol": label}
    more = {"SecondOrderBoosting": SecondOrderBoosting(features, label, False, trees, boost_depth, step)} if second_order else {}
    return more | {
        "LinearRegression": LinearRegression(**common),
        "DecisionTree": binned_trees(DecisionTreeRegressor(seed=SEED, maxDepth=tree_depth, maxBins=64, **common)),
        "RandomForest": binned_trees(RandomForestRegressor(numTrees=trees, maxDepth=forest_depth, seed=SEED, **common)),
        "GradientBoosting": binned_trees(GBTRegressor(maxIter=trees, maxDepth=boost_depth, stepSize=step, seed=SEED, **common)),
    }


def classifiers(features: str = "features", label: str = "label", trees: int = 100, tree_depth: int = 30,
                forest_depth: int = 12, boost_depth: int = 6, step: float = 0.3, second_order: bool = False) -> dict:
    """M5: logistic, tree, forest and boosted classifiers; ``second_order`` as for the regressors."""
    common = {"featuresCol": features, "labelCol": label}
    more = {"SecondOrderBoosting": SecondOrderBoosting(features, label, True, trees, boost_depth, step)} if second_order else {}
    return more | {
        "LogisticRegression": LogisticRegression(maxIter=1000, **common),
        "DecisionTree": binned_trees(DecisionTreeClassifier(seed=SEED, maxDepth=tree_depth, maxBins=64, **common)),
        "RandomForest": binned_trees(RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=SEED, **common)),
        "GradientBoosting": binned_trees(GBTClassifier(maxIter=trees, maxDepth=boost_depth, stepSize=step, seed=SEED, **common)),
    }


def penalised(estimator, rows: int, c: float = 1.0):
    """The linear classifiers with the L2 penalty of ``|w|^2 / 2 + c * sum(loss)`` on the features as they are.

    MLlib divides the losses by the row count, so its penalty is ``1 / (c * rows)``; other estimators are returned as
    they are. (MLlib's support vector machine takes the hinge loss, not its square.)"""
    if not isinstance(estimator, (LogisticRegression, LinearSVC)):
        return estimator
    return estimator.copy({estimator.regParam: 1.0 / (c * max(rows, 1)), estimator.standardization: False})


def fit_all(estimators: dict, train: DataFrame, c: float = 1.0, at_once: int = 1) -> tuple[dict[str, Model], dict[str, float]]:
    """Fit each estimator, the linear classifiers with their penalty; returns the models and their fit times (seconds).

    With ``at_once`` so many fits run side by side (driver threads submit them): a fit of many short passes or of one
    task leaves most cores idle. A time then includes what the fit waited for the others."""
    from concurrent.futures import ThreadPoolExecutor

    rows = train.count()

    def run(est):
        t0 = time.time()
        few = isinstance(est, (LogisticRegression, LinearSVC))  # hundreds of short passes
        model = penalised(est, rows, c).fit(train.coalesce(max(-(-rows // CURVE_TASK_ROWS), 1)) if few else train)
        return model, time.time() - t0

    with ThreadPoolExecutor(max_workers=max(at_once, 1)) as pool:
        fitted = dict(zip(estimators, pool.map(run, estimators.values())))
    return {name: m for name, (m, _) in fitted.items()}, {name: t for name, (_, t) in fitted.items()}


def regression_leaderboard(models: dict[str, Model], test: DataFrame, label: str = "label") -> DataFrame:
    """M4 + M10 + M13: R² and RMSE of each model on the test rows, best first."""
    rows = []
    for name, m in models.items():
        r = regression_metrics(m.transform(test), label, "prediction").first()
        rows.append((name, float(r["r2"]), float(r["rmse"])))
    spark = test.sparkSession
    return spark.createDataFrame(rows, "model string, r2 double, rmse double").orderBy(F.col("r2").desc(), "model")


def classification_leaderboard(models: dict[str, Model], test: DataFrame, label: str = "label",
                               times: dict[str, float] | None = None, train: DataFrame | None = None) -> DataFrame:
    """M5/M7 + M11 + M13: accuracy and weighted precision / recall / F1 per model on the test rows;
    with ``train`` also the accuracy on the training rows and on all rows."""
    rows = []

    def judged(m, df):
        return m.transform(df).withColumn("prediction", F.col("prediction").cast("int"))

    n_test = test.count() if train is not None else 0
    n_train = train.count() if train is not None else 0
    for name, m in models.items():
        r = classification_metrics(judged(m, test), label, "prediction").first()
        own = overall = None
        if train is not None:
            own = float(classification_metrics(judged(m, train), label, "prediction").first()["accuracy"])
            overall = (own * n_train + float(r["accuracy"]) * n_test) / max(n_train + n_test, 1)
        rows.append((name, float(r["accuracy"]), float(r["precision"]), float(r["recall"]), float(r["f1"]),
                     float((times or {}).get(name, 0.0)), own, overall))
    schema = ("model string, accuracy double, precision double, recall double, f1 double, fit_seconds double, "
              "train_accuracy double, overall_accuracy double")
    board = test.sparkSession.createDataFrame(rows, schema).orderBy(F.col("accuracy").desc(), "model")
    return board if train is not None else board.drop("train_accuracy", "overall_accuracy")


def confusions(models: dict[str, Model], test: DataFrame, label: str = "label") -> DataFrame:
    """M12 for every model: (model, label, prediction, n)."""
    out = None
    for name, m in models.items():
        cells = confusion_counts(m.transform(test).withColumn("prediction", F.col("prediction").cast("int")), label, "prediction")
        cells = cells.select(F.lit(name).alias("model"), "label", "prediction", "n")
        out = cells if out is None else out.unionByName(cells)
    return out


class RidgeClassifierModel:
    """Least squares on ±1 targets with an L2 penalty; class = sign."""

    def __init__(self, model, features: str):
        self.model, self.features = model, features

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.withColumnRenamed("prediction", "_prev_pred") if "prediction" in df.columns else df)
        return out.withColumn("prediction", (F.col("prediction") > 0).cast("double"))


def ridge_classifier(train: DataFrame, features: str = "features", label: str = "label", alpha: float = 1.0) -> RidgeClassifierModel:
    """sum((y - Xw - b)^2) + alpha |w|^2, y = +-1, unpenalised intercept.

    MLlib minimises (1/2n) sum(...) + (reg/2)|w|^2 on a label scaled to unit deviation, which
    weakens the penalty by that deviation; reg = alpha std(y) / n undoes it."""
    target = train.withColumn("_pm1", F.when(F.col(label) > 0, 1.0).otherwise(-1.0))
    n, std = target.agg(F.count(F.lit(1)), F.stddev_pop("_pm1")).first()
    lr = LinearRegression(featuresCol=features, labelCol="_pm1", regParam=alpha * (std or 1.0) / max(n, 1), elasticNetParam=0.0,
                          standardization=False, solver="auto")
    return RidgeClassifierModel(lr.fit(target), features)


def text_classifiers(features: str = "features", label: str = "label", trees: int = 100, forest_depth: int = 12,
                     boost_depth: int = 6, step: float = 0.3) -> dict:
    """M7: linear SVM, logistic regression, random forest, boosted trees."""
    common = {"featuresCol": features, "labelCol": label}
    return {
        "LinearSVC": LinearSVC(**common),
        "LogisticRegression": LogisticRegression(maxIter=500, **common),
        "RandomForest": binned_trees(RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=SEED, **common)),
        "GradientBoosting": binned_trees(GBTClassifier(maxIter=trees, maxDepth=boost_depth, stepSize=step, seed=SEED, **common)),
    }


def vote_predictions(models: dict, df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """M8 over fitted models: long (id, model, prediction) -> majority per id."""
    parts = []
    for name, m in models.items():
        p = m.transform(df).select(id_col, F.lit(name).alias("model"), F.col("prediction").cast("int").alias("prediction"))
        parts.append(p)
    votes = parts[0]
    for p in parts[1:]:
        votes = votes.unionByName(p)
    voted = hard_vote(votes, id_col)
    return voted.join(df.select(id_col, label), id_col)


#: Rows of one task of an iterative fit that keeps them in memory as objects, many times their size on disk.
FIT_ROWS = 1_000_000


def segment(df: DataFrame, cols: list[str], k: int = 3, seed: int = SEED, min_rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """M9: K-means on z-scored columns (population std); returns the rows with
    their cluster and the centres in original units."""
    data = df.na.drop(subset=cols)
    if data.limit(min_rows).count() < min_rows:
        raise ValueError(f"need at least {min_rows} complete rows for clustering")
    slim = right_size(data.select(*cols))
    z, stats = standardize(slim, cols, suffix="_z")
    assembled = VectorAssembler(inputCols=[c + "_z" for c in cols], outputCol="_x")
    fitted = assembled.transform(z).select("_x")
    tasks = -(-slim.count() // FIT_ROWS)
    if tasks > fitted.rdd.getNumPartitions():
        fitted = fitted.repartition(tasks)
    model = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4, featuresCol="_x", predictionCol="cluster").fit(fitted)
    drop_shared(slim)
    for c in cols:
        data = data.withColumn(c + "_z", (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1] or 1.0))
    labelled = model.transform(assembled.transform(data)).drop("_x", *[c + "_z" for c in cols])
    rows = []
    for i, center in enumerate(model.clusterCenters()):
        rows.append((i, *[float(center[j] * (stats[c][1] or 1.0) + stats[c][0]) for j, c in enumerate(cols)]))
    centers = df.sparkSession.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in cols))
    return labelled, centers


# The outcome's wording on the dashboard.
LIKELY, UNLIKELY = "LIKELY TO RETURN", "NOT LIKELY TO RETURN"


def score(model: Model, df: DataFrame, positive_label: str = LIKELY, negative_label: str = UNLIKELY) -> DataFrame:
    """Predicted class, probability of class 1 (when the model gives one)
    and a readable label."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability_1", vector_to_array("probability")[1])
    return out.withColumn(
        "outcome", F.when(F.col("prediction") == 1, F.lit(positive_label)).otherwise(F.lit(negative_label))
    )


def learning_curves(df: DataFrame, estimators: dict, label: str = "label", id_col: str = "id", folds: int = 5,
                    sizes: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), seed: int = SEED, at_once: int | None = None) -> DataFrame:
    """(model, train_size, train_accuracy, validation_accuracy): means over ``folds`` stratified folds at growing
    training sizes, for each of ``estimators``.

    Fold and size are two columns of one stored set: a hash cuts each class into folds, a second one gives
    the place from which on a row belongs to the training part. Fits do not wait for one another: ``at_once``
    driver threads submit them, each in a scheduler pool of its own (pools share the cores if the
    cluster schedules fairly). A fit makes hundreds of short passes, so it is cut into no more tasks than its rows
    are worth; unless ``at_once`` is given, as many fits run together as then fill the cores, and at least
    four. A training part with one class is left out.
    """
    from concurrent.futures import ThreadPoolExecutor

    from shelfwise.operators.features import stratified_folds

    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    data = right_size(stratified_folds(df, label, [id_col], folds, seed, name="_fold").withColumn("_u", place))
    tasks = max(-(-data.count() // CURVE_TASK_ROWS), 1)
    if at_once is None:
        at_once = max(4, spark.sparkContext.defaultParallelism // tasks)

    def accuracy(model, rows: DataFrame) -> float:
        judged = model.transform(rows).withColumn("prediction", F.col("prediction").cast("int"))
        return classification_metrics(judged, label, "prediction").first()["accuracy"]

    def run(job: tuple[str, float, int]):
        name, share, fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"curve-{name}-{fold}")
        train = data.where((F.col("_fold") != fold) & (F.col("_u") < F.lit(share if share < 1.0 else 2.0)))
        counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
        if len(counts) < 2:
            return None
        rows = sum(counts.values())
        model = penalised(estimators[name], rows).fit(train.coalesce(max(-(-rows // CURVE_TASK_ROWS), 1)))
        return rows, accuracy(model, train), accuracy(model, data.where(F.col("_fold") == fold))

    jobs = [(name, share, fold) for name in estimators for share in sizes for fold in range(folds)]
    with ThreadPoolExecutor(max_workers=max(at_once, 1)) as pool:
        results = dict(zip(jobs, pool.map(run, jobs)))
    drop_shared(data)
    out = []
    for name in estimators:
        for share in sizes:
            got = [r for f in range(folds) if (r := results[(name, share, f)])]
            if got:
                n, own, other = (sum(x) / len(got) for x in zip(*got))
                out.append((name, int(n), float(own), float(other)))
    return spark.createDataFrame(out, "model string, train_size int, train_accuracy double, validation_accuracy double")


def learning_curve(df: DataFrame, estimator, label: str = "label", id_col: str = "id", folds: int = 5,
                   sizes: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), seed: int = SEED, at_once: int | None = None) -> DataFrame:
    """:func:`learning_curves` of one estimator, without its name."""
    return learning_curves(df, {"model": estimator}, label, id_col, folds, sizes, seed, at_once).drop("model")
