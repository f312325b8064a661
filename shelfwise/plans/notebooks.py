"""The two notebooks' data flows (E2 feature preparation, E3 text study) as
compositions of the operators; every step is a Spark job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.parse import repeat_flag_expr
from shelfwise.operators import clean, features, metrics, models, neighbors, text
from shelfwise.operators.filters import distinct_rows

PRICE_COLUMNS = ["sell_price", "cost", "sell", "profit"]
SCALE_COLUMNS = ["sell_price", "cost", "sell", "profit", "age", "discount_pct"]
CATEGORY_COLUMNS = ["gender", "delivery"]


def prepare_features(merged: DataFrame, id_cols: list[str], outlier_cols: list[str] | None = None,
                     scale_cols: list[str] | None = None, category_cols: list[str] | None = None) -> dict:
    """Distinct rows, median/mode fills, profit and the high-value flag, repeated flag, sequential IQR filter, label codes,
    z-scores, then a stratified split on the high-value flag."""
    df = distinct_rows(merged)
    num = [c for c in clean.numeric_cols(df) if c not in id_cols]
    df, medians = clean.fill_median(df, num)
    df, modes = clean.fill_mode(df)
    df = clean.with_profit(df)
    df, threshold = clean.high_value_flag(df, "profit", 0.8)
    rep = [c for c in df.columns if "repeated" in c.lower() and "customer" in c.lower() and not c.endswith("_flag")]
    if rep:
        df = df.withColumn(rep[0], repeat_flag_expr(rep[0], bangla=False))
    df, report = clean.iqr_filter(df, [c for c in (outlier_cols or PRICE_COLUMNS) if c in df.columns])
    df = clean.label_encode(df, [c for c in (category_cols or CATEGORY_COLUMNS) if c in df.columns])
    df, stats = clean.standardize(df, [c for c in (scale_cols or SCALE_COLUMNS) if c in df.columns])
    df = features.stratified_split(df, "high_value_customer", id_cols)
    return {"data": df, "medians": medians, "modes": modes, "threshold": threshold, "outliers": report,
            "scaling": stats}


def compare_classifiers(data: DataFrame, label: str, cols: list[str], id_col: str, k: int = 5, trees: int = 100) -> DataFrame:
    """Logistic, tree, forest, boosted and nearest-neighbour classifiers on a split set (``is_test``)."""
    from pyspark.ml.feature import VectorAssembler

    d = data.select(id_col, "is_test", F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    d = models.right_size(VectorAssembler(inputCols=cols, outputCol="features").transform(d))
    train, test = d.where("is_test = 0"), d.where("is_test = 1")
    fitted, times = models.fit_all(models.classifiers(trees=trees), train)
    board = models.classification_leaderboard(fitted, test, times=times).drop("fit_seconds")
    vec = F.array(*cols).alias("vec")
    near = neighbors.knn(train.select(id_col, "label", vec), test.select(id_col, vec), k=k, vec="vec", id_col=id_col, label="label")
    got = near.join(test.select(id_col, "label"), id_col).withColumn("prediction", F.col("prediction").cast("int"))
    mine = metrics.classification_metrics(got).select(F.lit("KNeighbors").alias("model"), "accuracy", "precision", "recall", "f1")
    return board.unionByName(mine).orderBy(F.col("accuracy").desc(), "model")


def compare_regressors(data: DataFrame, label: str, cols: list[str], id_col: str, k: int = 5, trees: int = 100) -> DataFrame:
    """Linear, tree, forest, boosted and nearest-neighbour regressors on a split set (``is_test``)."""
    from pyspark.ml.feature import VectorAssembler

    d = data.select(id_col, "is_test", F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    d = models.right_size(VectorAssembler(inputCols=cols, outputCol="features").transform(d))
    train, test = d.where("is_test = 0"), d.where("is_test = 1")
    fitted, _ = models.fit_all(models.regressors(trees=trees), train)
    board = models.regression_leaderboard(fitted, test)
    vec = F.array(*cols).alias("vec")
    near = neighbors.knn(train.select(id_col, "label", vec), test.select(id_col, vec), k=k, vec="vec", id_col=id_col, label="label", task="regress")
    mine = metrics.regression_metrics(near.join(test.select(id_col, "label"), id_col)).select(F.lit("KNeighbors").alias("model"), "r2", "rmse")
    return board.unionByName(mine).orderBy(F.col("r2").desc(), "model")


def text_study(texts: DataFrame, max_features: int = 20000, trees: int = 100) -> dict:
    """Clean and de-duplicate, character TF-IDF, stratified split, the
    classifiers and the hard-voting ensemble, with their metrics."""
    cleaned = text.prepare_texts(texts)
    weights, vocab = text.char_tfidf(cleaned, max_features=max_features)
    size = vocab.count()
    feats = text.to_sparse(weights, size).join(cleaned.select("doc_id", "label"), "doc_id")
    data = models.right_size(features.stratified_split(feats, "label", ["doc_id"]))
    train, test = data.where("is_test = 0"), data.where("is_test = 1")
    fitted, times = models.fit_all(models.text_classifiers(trees=trees), train, at_once=4)
    fitted["RidgeClassifier"] = models.ridge_classifier(train)
    board = models.classification_leaderboard(fitted, test, times=times, train=train)
    voters = {k: fitted[k] for k in ["LinearSVC", "LogisticRegression", "RandomForest", "RidgeClassifier"]}
    voted = models.vote_predictions(voters, test, "doc_id")
    return {"leaderboard": board, "confusions": models.confusions(fitted, test), "ensemble": metrics.classification_metrics(voted),
            "confusion": metrics.confusion(voted.withColumn("prediction", F.col("prediction").cast("int")))}
