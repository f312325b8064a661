"""Property checks for operators without a closed SQL form (and for the
scalable code paths the small fixtures would not reach)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    from shelfwise.operators import stats
    from shelfwise.operators.stats import exact_quantiles

    rnd = random.Random(7)
    vals = [rnd.gauss(0, 1) for _ in range(5000)] + [5.0] * 300  # a heavy tie too
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.97, 1.0]
    want = np.quantile(np.array(vals), qs)
    for read_off in (5000, 40):  # few rows left to read, and many rounds of narrowing
        monkeypatch.setattr(stats, "READ_OFF", read_off)
        assert exact_quantiles(df, "x", qs) == pytest.approx(list(want), abs=1e-12)


def test_quantiles_of_tied_and_extreme_columns_in_few_jobs(spark):
    from shelfwise.operators.features import prepare_xy
    from shelfwise.operators.stats import exact_quantiles_by, order_statistics

    n = 5_000_000
    df = spark.range(n).select(
        F.expr("cast(id % 10 = 0 as int)").alias("bit"), (F.col("id") % 10).alias("ten"), F.lit(7.0).alias("one"),
        F.when(F.col("id") % 2 == 0, F.lit(1e300)).otherwise(F.col("id").cast("double") * -1e-300).alias("wide"),
        F.lit(None).cast("double").alias("none"),
    )
    qs = [0.25, 0.5, 0.9, 0.95]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    got = exact_quantiles_by(df, {c: qs for c in df.columns})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("quantiles")) <= 40  # for 20 quantiles of 5 columns
    assert got["bit"] == [0.0, 0.0, 0.0 + 0.9 * (n - 1) - np.floor(0.9 * (n - 1)), 1.0]
    assert got["ten"] == [2.0, 4.5, 8.0 + 0.9 * (n - 1) - np.floor(0.9 * (n - 1)), 9.0]
    assert got["one"] == [7.0] * 4 and got["none"] == [None] * 4
    wide = np.concatenate([np.full(n // 2, 1e300), -1e-300 * np.arange(1, n, 2)])
    assert got["wide"] == pytest.approx(list(np.quantile(wide, qs)), rel=1e-9)
    big = spark.range(100).select((F.col("id") + 2**62).alias("k"))
    assert order_statistics(big, "k", [0, 57, 99], with_counts=True) == [(2**62, 0, 1), (2**62 + 57, 57, 1), (2**62 + 99, 99, 1)]
    kind = F.element_at(F.array(*map(F.lit, "abc")), (F.col("ten") % 3 + 1).cast("int"))
    x, names = prepare_xy(df.withColumn("kind", kind), "one", ["bit", "kind"], vector=None)
    assert names == ["bit", "kind_b", "kind_c"] and x.count() == n


def test_split_keeps_rows_with_missing_and_repeated_keys(spark):
    from shelfwise.operators.features import split, stratified_split

    df = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("a"), F.lit(1).alias("b"), (F.col("id") % 3).alias("c"))
    df = df.unionByName(df.limit(7))
    for sql_hash in (True, False):
        out = split(df, ["a", "b"], 0.3, sql_hash=sql_hash)
        got = {r["is_test"]: r["count"] for r in out.groupBy("is_test").count().collect()}
        assert got == {1: math.ceil(0.3 * 107), 0: 107 - math.ceil(0.3 * 107)}
        many = stratified_split(df.withColumn("label", F.col("a")), "label", ["a", "b"], 0.5, sql_hash=sql_hash)
        assert many.count() == 107 and many.where("is_test IS NULL").count() == 0


def test_global_index_is_a_permutation(spark):
    from shelfwise.operators.rank import global_index

    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    out = global_index(df, [F.col("k").desc()], name="i").collect()
    pairs = sorted((r["i"], r["k"]) for r in out)
    assert [p[0] for p in pairs] == list(range(1, 1001))
    assert [p[1] for p in pairs] == list(range(999, -1, -1))


def test_split_exact_disjoint_complete(spark):
    from shelfwise.operators.features import split
    from shelfwise.sources import LINE_KEY, sales_view

    s = sales_view(spark, SF_SMALL).select(*LINE_KEY)
    n = s.count()
    a = split(s, LINE_KEY, 0.2, sql_hash=True)
    b = split(s, LINE_KEY, 0.2, sql_hash=True)
    assert a.count() == n
    assert a.where("is_test = 1").count() == math.ceil(0.2 * n)
    assert a.exceptAll(b).count() == 0  # repeatable


def test_stratified_split_shares(spark):
    from shelfwise.operators.features import stratified_split

    df = spark.range(0, 997).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    out = stratified_split(df, "label", ["id"], 0.2)
    per = {r["label"]: (r["n"], r["t"]) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    for label, (n, t) in per.items():
        assert t == math.ceil(0.2 * n)


def test_dedup_keeps_first_row(spark):
    from shelfwise.operators.filters import dedup_first

    df = spark.createDataFrame([(1, None, 3, "c"), (1, None, 1, "a"), (1, None, 2, "b"), (2, "x", 5, "z")],
                               "k int, k2 string, o int, v string")
    got = sorted(tuple(r) for r in dedup_first(df, ["k", "k2"], ["o"]).collect())
    assert got == [(1, None, 1, "a"), (2, "x", 5, "z")]


def test_hard_vote_identical_voters(spark):
    from shelfwise.operators.metrics import hard_vote

    base = [(i, i % 3) for i in range(50)]
    votes = spark.createDataFrame([(i, m, p) for i, p in base for m in "abc"], "id int, model string, prediction int")
    assert sorted(tuple(r) for r in hard_vote(votes).collect()) == base
    tie = spark.createDataFrame([(1, "a", 2), (1, "b", 0)], "id int, model string, prediction int")
    assert hard_vote(tie).first()["prediction"] == 0


def test_decompose_recovers_line_and_season(spark):
    from shelfwise.operators.series import decompose

    season = [3.0, -1.0, 0.5, 2.0, -4.0, 1.0, 0.0, -2.0, 1.5, 0.5, -0.5, -1.0]
    mean_s = sum(season) / 12
    rows = [(i, 10.0 + 2.0 * i + season[i % 12]) for i in range(48)]
    df = spark.createDataFrame(rows, "t int, y double")
    out = {r["t"]: r for r in decompose(df, "y", 12, order="t", extrapolate=True).collect()}
    for i in range(48):
        assert out[i]["trend"] == pytest.approx(10.0 + 2.0 * i + mean_s, abs=1e-9)
        assert out[i]["seasonal"] == pytest.approx(season[i % 12] - mean_s, abs=1e-9)
        assert out[i]["resid"] == pytest.approx(0.0, abs=1e-9)


def test_resample_fills_month_gaps_with_zero(spark):
    from shelfwise.operators.series import resample
    from shelfwise.sources import sales_view

    s = sales_view(spark, SF_SMALL).where(~F.month("order_date").isin(3, 7))
    out = resample(s, "sell", "month", name="sell").collect()
    gaps = [r for r in out if r["period_end"].month in (3, 7)]
    assert gaps and all(r["sell"] == 0.0 for r in gaps)
    months = sorted(r["period_end"] for r in out)
    assert len(months) == len(set(months))


def test_kmeans_centres_are_member_means(spark):
    from shelfwise.operators.models import segment
    from shelfwise.plans.views import filtered

    cols = ["age", "unit", "sell", "profit"]
    labelled, centers = segment(filtered(spark, SF_SMALL), cols, k=3)
    means = {r["cluster"]: r for r in labelled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).collect()}
    for c in centers.collect():
        for col in cols:
            assert c[col] == pytest.approx(means[c["cluster"]][col], rel=1e-3, abs=1e-3)


def test_iqr_filter_is_sequential(spark):
    from shelfwise.operators.clean import iqr_filter

    rows = [(float(i), float(i % 10)) for i in range(100)] + [(1000.0, 5.0), (50.0, 500.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out, report = iqr_filter(df, ["a", "b"])
    assert [r["removed"] for r in report] == [1, 1]
    assert out.count() == 100


def test_ridge_classifier_separates(spark):
    from pyspark.ml.linalg import Vectors

    from shelfwise.operators.models import ridge_classifier

    rows = [(Vectors.dense([float(x)]), 1 if x > 0 else 0) for x in range(-20, 21) if x != 0]
    df = spark.createDataFrame(rows, ["features", "label"])
    m = ridge_classifier(df)
    preds = m.transform(df).select((F.col("prediction") == F.col("label")).cast("int").alias("ok"))
    assert preds.agg(F.avg("ok")).first()[0] == 1.0


def _hw_python(y, m, a, b, g):
    l = sum(y[:m]) / m
    tr = (sum(y[m:2 * m]) - sum(y[:m])) / m / m
    s = [v - l for v in y[:m]]
    fits, sse = [], 0.0
    for t in range(m, len(y)):
        p = t % m
        fit = l + tr + s[p]
        nl = a * (y[t] - s[p]) + (1 - a) * (l + tr)
        nb = b * (nl - l) + (1 - b) * tr
        s[p] = g * (y[t] - l - tr) + (1 - g) * s[p]
        l, tr = nl, nb
        fits.append(fit)
        sse += (y[t] - fit) ** 2
    fc = [l + k * tr + s[(len(y) - 1 + k) % m] for k in range(1, 4)]
    return fits, fc, sse


def test_holt_winters_matches_brute_force(spark):
    import datetime as dt

    from shelfwise.operators.forecast import holt_winters

    rnd = random.Random(3)
    y = [100 + 2 * t + 10 * math.sin(t / 2) + rnd.random() for t in range(40)]
    ends = []
    d = dt.date(2020, 1, 31)
    for _ in y:
        ends.append(d)
        d = (dt.date(d.year + (d.month // 12), d.month % 12 + 1, 1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    df = spark.createDataFrame(list(zip(ends, y)), "period_end date, v double")
    rows, chosen = holt_winters(df, "v", params=(0.3, 0.1, 0.2), h=3)
    got = [r["fitted"] for r in rows.orderBy("period_end").collect()]
    fits, fc, sse = _hw_python(y, 12, 0.3, 0.1, 0.2)
    assert got == pytest.approx(fits + fc, rel=1e-12)
    assert chosen.first()["sse"] == pytest.approx(sse, rel=1e-12)
    # the grid search picks the triple with the smallest SSE among the grid
    _, best = holt_winters(df, "v", h=3, grid=[0.1, 0.5, 0.9], refine=False)
    b = best.first()
    brute = min((_hw_python(y, 12, a, bb, g)[2], a, bb, g) for a in (0.1, 0.5, 0.9) for bb in (0.1, 0.5, 0.9) for g in (0.1, 0.5, 0.9))
    assert b["sse"] == pytest.approx(brute[0], rel=1e-9)


@pytest.mark.parametrize("loss", ["log", "perceptron", "passive_aggressive"])
def test_online_linear_learns_separable_data(spark, loss):
    from shelfwise.operators.online import fit_online, predict_online

    rnd = random.Random(5)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, [0, 1 + rnd.randrange(5)], [1.0 if y else -1.0, rnd.random() * 0.1], y))
    df = spark.createDataFrame(rows, "doc_id long, indices array<int>, values array<double>, label int").repartition(4)
    w, b = fit_online(df, 6, loss=loss, epochs=5)
    preds = predict_online(df, w, b).join(df.select("doc_id", "label"), "doc_id")
    acc = preds.select((F.col("prediction") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert acc == 1.0


def test_short_single_series_is_refused(spark):
    import datetime as dt

    from shelfwise.operators.forecast import holt_winters
    from shelfwise.operators.series import decompose

    df = spark.createDataFrame([(dt.date(2020, m, 28), float(m)) for m in range(1, 13)], "period_end date, v double")
    with pytest.raises(ValueError):
        decompose(df, "v", 12)
    with pytest.raises(ValueError):
        holt_winters(df, "v")


def test_char_ngrams_chunked_equal_whole(spark):
    from collections import Counter

    from shelfwise.operators.text import char_ngram_counts

    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abc  dé€") for _ in range(n)) for n in (0, 1, 2, 7, 50, 333)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in char_ngram_counts(df, chunk=5).collect()}
    want = {}
    import re as _re

    for i, t in enumerate(texts):
        t = _re.sub(r"\s\s+", " ", t.lower())
        c = Counter(t[p:p + n] for n in (1, 2, 3) for p in range(len(t) - n + 1))
        want.update({(i, k): v for k, v in c.items()})
    assert got == want


def test_dedup_hot_key_is_limited_map_side(spark):
    from shelfwise.operators.filters import dedup_first

    n = 3000
    rows = [(0 if i % 3 == 0 else i, i, float(i)) for i in range(n)]  # key 0 holds a third of all rows
    df = spark.createDataFrame(rows, "k long, o long, v double").repartition(6)
    out = dedup_first(df, ["k"], ["o"])
    got = dict((r["k"], r["o"]) for r in out.collect())
    assert got[0] == 0 and len(got) == 1 + sum(1 for i in range(n) if i % 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_split_with_hash_ties_takes_exact_count(spark):
    from shelfwise.operators.features import _first_by_hash

    rows = [(i, i // 10) for i in range(200)]  # every hash value shared by 10 rows
    df = spark.createDataFrame(rows, "id long, _h long")
    out = _first_by_hash(df, ["id"], 37, "is_test")
    picked = sorted(r["id"] for r in out.where("is_test = 1").collect())
    assert picked == list(range(37))


def test_book_list_is_broadcast_by_its_known_bytes(spark):
    from shelfwise.operators.filters import join_books

    sales = spark.range(1000).select(F.concat(F.lit("b"), F.col("id") % 50).alias("book"))
    books = spark.range(60).select(F.concat(F.lit("B"), F.col("id")).alias("book"), F.col("id").alias("shelf"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, node in (("10m", "BroadcastHashJoin"), ("16b", "SortMergeJoin")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = join_books(sales, books)._jdf.queryExecution().executedPlan().toString()
            assert node in plan
        assert join_books(sales, books).where("shelf IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)



def test_holt_winters_refinement_never_worse(spark):
    import datetime as dt

    from shelfwise.operators.forecast import holt_winters

    rnd = random.Random(9)
    y = [50 + 0.5 * t + 8 * math.cos(t / 1.9) + rnd.gauss(0, 1) for t in range(36)]
    ends, d = [], dt.date(2019, 1, 31)
    for _ in y:
        ends.append(d)
        d = (dt.date(d.year + (d.month // 12), d.month % 12 + 1, 1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    df = spark.createDataFrame(list(zip(ends, y)), "period_end date, v double")
    coarse = holt_winters(df, "v", refine=False)[1].first()["sse"]
    fine = holt_winters(df, "v", refine=True)[1].first()
    assert fine["sse"] <= coarse + 1e-9
    assert 0 < fine["alpha"] < 1 and 0 < fine["beta"] < 1 and 0 < fine["gamma"] < 1


def test_exact_medians(spark):
    from shelfwise.operators.stats import exact_medians

    rnd = random.Random(1)
    rows = [(rnd.random(), float(rnd.randrange(10)) if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = {"a": float(np.median([r[0] for r in rows])), "b": float(np.median([r[1] for r in rows if r[1] is not None]))}
    assert exact_medians(df, ["a", "b"]) == pytest.approx(want)


def test_ridge_equals_the_closed_form_on_unbalanced_labels(spark):
    from pyspark.ml.linalg import Vectors

    from shelfwise.operators.models import ridge_classifier

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 5.0, 0.3]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=600) > 2.0).astype(int)  # a small share of positives
    df = spark.createDataFrame([(Vectors.dense(v), int(c)) for v, c in zip(x.tolist(), y)], ["features", "label"])
    for alpha in (1.0, 400.0):
        t = np.where(y > 0, 1.0, -1.0)
        xc = x - x.mean(axis=0)
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (t - t.mean()))
        assert ridge_classifier(df, alpha=alpha).model.coefficients.toArray() == pytest.approx(want, rel=1e-4)


def test_fourier_forecast_from_one_year_of_history(spark):
    import datetime as dt

    from shelfwise.operators.forecast import fourier_forecast

    for n in (11, 12, 18):
        months = [(2023 + i // 12, i % 12 + 1) for i in range(n)]
        ends = [(dt.date(y + (m // 12), m % 12 + 1, 1) - dt.timedelta(days=1)) for y, m in months]
        df = spark.createDataFrame([(d, 100.0 + 3 * i + (20 if d.month == 12 else 0)) for i, d in enumerate(ends)], "period_end date, v double")
        out = fourier_forecast(df, "v", h=6).collect()
        assert len(out) == (0 if n < 12 else n + 6)
        assert all(np.isfinite(r["yhat"]) for r in out)


def test_confusion_and_metrics_of_many_classes(spark):
    from shelfwise.operators.metrics import classification_metrics, confusion_counts

    df = spark.range(40_000).select((F.col("id") % 20_000).cast("int").alias("label"), F.when(F.col("id") % 4 > 0, F.col("id") % 20_000).otherwise(F.lit(7)).cast("int").alias("prediction"))
    assert confusion_counts(df).count() == 20_000
    m = classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.75) and m["recall"] == pytest.approx(0.75)
