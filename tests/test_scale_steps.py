"""Steps that must stay cheap on large tables: how often the input is read, how much is sorted, how large a task is."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfwise.operators import boosting, models, neighbors, stats


def _counted(spark, df):
    """``df`` and an accumulator of its rows read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), seen


def test_rows_around_split_points_are_one_grouped_count(spark):
    rows = spark.createDataFrame([(float(i % 7), i) for i in range(100)] + [(None, None)], "a double, b long")
    got = stats._counts(rows, {"a": [0.0, 2.5, 3.0, 6.0], "b": [0, 50, 99]})
    assert got == {"a": {0.0: (0, 15), 2.5: (44, 44), 3.0: (44, 58), 6.0: (86, 100)}, "b": {0: (0, 1), 50: (50, 51), 99: (99, 100)}}


def test_boosting_reads_its_input_once(spark):
    df = spark.range(500).select((F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    df, seen = _counted(spark, df)
    boosting.fit_boosted(df, ["x"], "y", trees=1, depth=2, bins=4, exact=True)
    assert seen.value == 500


def test_nearest_sorts_candidates_only(monkeypatch):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(900, 3)) * 20)  # ties
    pdf = pd.DataFrame({"query": (np.arange(900) % 3 == 0).astype(int), "id": r.permutation(900), "v": list(x), "label": r.normal(size=900)})
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **k: sizes.append(max(np.size(a) for a in keys)) or sort(keys, **k))
    got = neighbors._block_nearest(5)(pdf)
    monkeypatch.undo()
    assert max(sizes) < 64 * 600 / 10
    t, q = pdf[pdf["query"] == 0], pdf[pdf["query"] == 1]
    for _, one in q.iterrows():
        d2 = ((np.stack(t["v"].to_numpy()) - one["v"]) ** 2).sum(axis=1)
        best = t["id"].to_numpy()[np.lexsort((t["id"].to_numpy(), d2))[:5]]
        assert got.loc[got["query_id"] == one["id"], "neighbor_id"].tolist() == best.tolist()


def test_segments_are_fitted_in_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.range(400).coalesce(1).select((F.col("id") % 4 * 10.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    tasks, fit = [], models.KMeans.fit
    monkeypatch.setattr(models, "FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(models.KMeans, "fit", lambda self, d, *a: tasks.append(d.rdd.getNumPartitions()) or fit(self, d, *a))
    labelled, _ = models.segment(df, ["a", "b"], k=2)
    assert tasks and tasks[0] >= 4
    assert labelled.count() == 400


def test_grams_leave_their_text_as_distinct_terms(spark):
    from shelfwise.operators.text import char_ngram_counts

    plan = char_ngram_counts(spark.createDataFrame([(1, "abab")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower()  # no row for each character


def test_tfidf_reads_its_texts_once_and_sums_rows_that_share_an_id(spark):
    from collections import Counter
    from math import log, sqrt

    from shelfwise.operators.text import char_tfidf

    texts = [(1, "Ab  ab"), (2, "b\x00a😀"), (2, "abé"), (None, "aab"), (3, ""), (4, None), (5, "b" * 9)]
    for rows in (texts, texts[:2] + texts[4:]):  # without repeated and missing ids, all documents are counted where they lie
        df, seen = _counted(spark, spark.createDataFrame(rows, "doc_id long, text string"))
        weights, vocab = char_tfidf(df, max_features=12)
        got = {(r["doc_id"], r["term"]): (r["tf"], r["tfidf"], r["feature_index"]) for r in weights.collect()}
        assert seen.value == len(rows)
        tf: dict = {}
        for i, t in rows:
            t = (t or "").lower().replace("  ", " ")
            tf.setdefault(i, Counter()).update(t[p : p + n] for n in (1, 2, 3) for p in range(len(t) - n + 1))
        total, held = sum(tf.values(), Counter()), Counter(w for i, c in tf.items() if i is not None for w in c)
        terms = sorted(sorted(total, key=lambda w: (-total[w], w))[:12])
        idf = {w: log((1 + len(tf)) / (1 + held[w])) + 1 for w in terms}
        want = {}
        for i, c in tf.items():
            norm = sqrt(sum((c[w] * idf[w]) ** 2 for w in terms))
            want.update({(i, w): (c[w], c[w] * idf[w] / norm, terms.index(w)) for w in terms if c[w]})
        assert got.keys() == want.keys()
        assert all(got[k][::2] == want[k][::2] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
        assert {r["term"]: (r["corpus_count"], r["df"]) for r in vocab.collect()} == {w: (total[w], held[w]) for w in terms}


def test_vocabulary_reads_its_texts_once(spark):
    from shelfwise.operators.text import fit_vocab

    df, seen = _counted(spark, spark.createDataFrame([(i, f"a w{i % 7}") for i in range(60)], "doc_id long, text string"))
    assert {r["word"]: r["count"] for r in fit_vocab(df).collect()}["a"] == 60
    assert seen.value == 60


def test_votes_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    from shelfwise.operators import metrics

    monkeypatch.setattr(metrics, "VOTE_ROWS", 10, raising=False)
    votes = spark.range(400).selectExpr("id div 4 as id", "cast(id % 4 as string) as model", "cast(id % 4 > 1 as int) as prediction")
    voted = metrics.hard_vote(votes)
    assert voted.rdd.getNumPartitions() >= 40
    assert voted.where("prediction = 0").count() == 100  # a tie each: the smaller label


def test_narrow_training_sets_are_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100, raising=False)
    cores = spark.sparkContext.defaultParallelism
    got = models.right_size(spark.range(100 * max(cores, 2)).coalesce(1))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100 * max(cores, 2) and max(sizes) <= 2 * sum(sizes) / max(cores, 2)
    assert models.right_size(spark.range(99).coalesce(1)).rdd.getNumPartitions() == 1


def test_small_fits_of_a_curve_are_not_cut_into_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "CURVE_TASK_ROWS", 100, raising=False)
    seen = []

    class Constant:
        def fit(self, train):
            seen.append((train.count(), train.rdd.getNumPartitions()))
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(1.0))

    data = spark.range(300).selectExpr("id", "cast(id % 2 as int) as label")
    monkeypatch.setattr(models, "right_size", lambda df: models.shared_table(df.repartition(6)))
    got = models.learning_curve(data, Constant(), folds=3, sizes=(0.2, 1.0)).collect()
    assert len(seen) == 6 and all(parts <= -(-rows // 100) for rows, parts in seen)
    assert [round(r["train_accuracy"], 1) for r in got] == [0.5, 0.5]
