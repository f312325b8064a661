"""Small unit checks for operators the oracle covers only through the fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def test_join_books_dedups_and_renames_clashes(spark):
    from shelfwise.operators.filters import join_books

    sales = spark.createDataFrame([(1, " The Book ", 10.0), (2, "other", 5.0)], "id int, book string, price double")
    books = spark.createDataFrame([("the book", 3, 99.0), ("THE BOOK", 1, 50.0), ("x", 2, 1.0)],
                                  "book string, book_no int, price double")
    out = {r["id"]: r for r in join_books(sales, books, book_order=["book_no"]).collect()}
    assert out[1]["book"] == "the book" and out[1]["book_no"] == 1 and out[1]["book_price"] == 50.0
    assert out[1]["price"] == 10.0
    assert out[2]["book_no"] is None


def test_standardize_zero_spread_and_inverse(spark):
    from shelfwise.operators.clean import standardize, unstandardize

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    z, stats = standardize(df, ["a", "b"], suffix="_z")
    rows = z.orderBy("a").collect()
    assert [r["b_z"] for r in rows] == [0.0, 0.0, 0.0]
    assert rows[0]["a_z"] == pytest.approx(-1.224744871, rel=1e-9)  # population std
    back = unstandardize(z.select(F.col("a_z").alias("a"), F.col("b_z").alias("b")), stats)
    assert [r["a"] for r in back.collect()] == pytest.approx([1.0, 2.0, 3.0])


def test_fill_rules(spark):
    from shelfwise.operators.clean import fill_median, fill_mode, fill_unknown, fill_zero

    df = spark.createDataFrame([(1.0, "b", None), (None, "a", None), (3.0, None, None), (10.0, "a", None)],
                               "x double, s string, t string")
    filled, med = fill_median(df, ["x"])
    assert med["x"] == 3.0 and filled.where("x is null").count() == 0
    moded, modes = fill_mode(df, ["s", "t"])
    assert modes == {"s": "a", "t": "unknown"}
    assert fill_unknown(df).where("t = 'Unknown'").count() == 4
    assert fill_zero(df).where("x = 0 and s = '0'").count() == 0
    assert fill_zero(df).where("x = 0").count() == 1


def test_mode_tie_takes_smallest(spark):
    from shelfwise.operators.clean import column_mode

    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    assert column_mode(df, "s") == "a"


def test_to_ts_and_date_parts(spark):
    from shelfwise.functions import to_ts
    from shelfwise.operators.clean import date_parts

    df = spark.createDataFrame([("2024-03-05 10:11:12", 2020), ("2024-03-05", 2020), ("junk", 2021), (None, None)],
                               "d string, year int")
    out = date_parts(df.withColumn("order_date", to_ts("d")), default_year=1999).collect()
    assert out[0]["order_date"] == dt.datetime(2024, 3, 5, 10, 11, 12)
    assert out[1]["order_date"] == dt.datetime(2024, 3, 5)
    assert [r["year"] for r in out] == [2024, 2024, 2021, 1999]
    assert [r["month"] for r in out] == [3, 3, None, None]


def test_apply_filters_semantics(spark):
    from shelfwise.operators.filters import ALL, apply_filters

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, c string")
    assert apply_filters(df, c=[]).count() == 3
    assert apply_filters(df, c=None).count() == 3
    assert apply_filters(df, c=ALL).count() == 2
    assert [r["id"] for r in apply_filters(df, c=["b"]).collect()] == [3]
    assert apply_filters(df, missing_column=["x"]).count() == 3


def test_read_yearly_keeps_own_year_column(spark, tmpdir_fresh):
    import os

    from shelfwise.sources import read_yearly, write_csv

    a = spark.createDataFrame([(1, 2022), (2, None)], "id int, year int")
    p = os.path.join(tmpdir_fresh, "Sell - 2023.csv")
    write_csv(a, p)
    got = {r["id"]: r["year"] for r in read_yearly(spark, [p]).collect()}
    assert got == {"1": 2022, "2": 2023}


def test_period_labels_follow_pandas(spark):
    from shelfwise.operators.series import resample

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 7), 2.0),
                                (dt.datetime(2024, 1, 8), 4.0), (dt.datetime(2025, 3, 2), 8.0)], "order_date timestamp_ntz, v double")
    weeks = resample(df, "v", "week", name="v").orderBy("period_end").collect()
    assert weeks[0]["period_end"] == dt.date(2024, 1, 7) and weeks[0]["v"] == 3.0  # Mon 1st .. Sun 7th
    assert weeks[1]["period_end"] == dt.date(2024, 1, 14) and weeks[1]["v"] == 4.0
    assert all(r["period_end"].weekday() == 6 for r in weeks)
    years = resample(df, "v", "year", name="v").orderBy("period_end").collect()
    assert [(r["period_end"], r["v"]) for r in years] == [(dt.date(2024, 12, 31), 7.0), (dt.date(2025, 12, 31), 8.0)]
    months = resample(df, "v", "month", name="v").collect()
    assert len(months) == 15 and sum(r["v"] for r in months) == 15.0


def test_rolling_and_growth_edges(spark):
    from shelfwise.operators.series import pct_change, rolling_mean

    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 4.0), (4, 6.0)], "t int, v double")
    r = rolling_mean(df, "v", 3, order="t", name="r").orderBy("t").collect()
    assert [x["r"] for x in r] == [None, None, 2.0, 4.0]
    g = pct_change(df, "v", "t", name="g").orderBy("t").collect()
    assert [x["g"] for x in g] == [None, None, 100.0, 50.0]  # zero base -> NULL, not inf


def test_metrics_against_hand_values(spark):
    from shelfwise.operators.metrics import binary_metrics, classification_metrics, confusion, regression_metrics

    y = [0, 0, 1, 1, 1, 2]
    p = [0, 1, 1, 1, 0, 1]  # class 2 never predicted -> its precision counts 0
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    m = classification_metrics(df).first()
    # per class: 0: p=1/2 r=1/2; 1: p=2/4 r=2/3; 2: p=0 r=0; supports 2, 3, 1
    prec = (2 * 0.5 + 3 * 0.5 + 1 * 0) / 6
    rec = (2 * 0.5 + 3 * (2 / 3) + 0) / 6
    f1 = (2 * 0.5 + 3 * (2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)) + 0) / 6
    assert m["accuracy"] == pytest.approx(3 / 6)
    assert (m["precision"], m["recall"], m["f1"]) == pytest.approx((prec, rec, f1))
    cm = {r["label"]: (r["pred_0"], r["pred_1"], r["pred_2"]) for r in confusion(df).collect()}
    assert cm == {0: (1, 1, 0), 1: (1, 2, 0), 2: (0, 1, 0)}
    scores = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, score double")
    b = binary_metrics(scores).first()
    assert (b["accuracy"], b["precision"], b["recall"], b["f1"]) == pytest.approx((0.5, 0.5, 0.5, 0.5))
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    r = regression_metrics(reg).first()
    assert r["r2"] == pytest.approx(1 - 0.5 / 2.0) and r["rmse"] == pytest.approx((0.5 / 3) ** 0.5)


def test_text_vocab_and_sequences(spark):
    from shelfwise.operators.text import fit_vocab, padded_sequences, prepare_texts, to_sequences

    raw = spark.createDataFrame([(3, "b a, a!", 1), (1, "b a, a!", 1), (2, "b a, a!", 0), (4, "c  a", 1), (5, None, 1)],
                                "doc_id long, text string, label int")
    t = prepare_texts(raw)
    assert sorted((r["doc_id"], r["text"]) for r in t.collect()) == [(1, "b a a"), (2, "b a a"), (4, "c a")]
    vocab = {r["word"]: (r["count"], r["index"]) for r in fit_vocab(t).collect()}
    assert vocab["<OOV>"] == (None, 1)
    assert vocab["a"] == (5, 2) and vocab["b"] == (2, 3) and vocab["c"] == (1, 4)
    seqs = {r["doc_id"]: r["sequence"] for r in to_sequences(t, fit_vocab(t), num_words=4).collect()}
    assert seqs == {1: [3, 2, 2], 2: [3, 2, 2], 4: [1, 2]}  # index 4 >= num_words -> OOV (1)
    padded = {r["doc_id"]: r["sequence"] for r in padded_sequences(to_sequences(t, fit_vocab(t)), 4).collect()}
    assert padded[4] == [4, 2, 0, 0]


def test_aggregate_edges(spark):
    from shelfwise.operators import aggs

    h = aggs.histogram(spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "age double"), "age", 5).collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 1]  # max lands in the last bin, empty bins kept
    assert h[-1]["bin_end"] == pytest.approx(10.0)

    sales = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 10), 5.0, "x", 2.0), (1, dt.datetime(2024, 3, 1), 7.0, "y", 2.0),
         (2, dt.datetime(2024, 2, 1), 12.0, "x", 1.0), (3, dt.datetime(2024, 3, 1), 12.0, "z", 3.0)],
        "customer int, order_date timestamp_ntz, sell double, book string, unit double")
    r = aggs.rfm(sales, as_of=dt.date(2024, 3, 31), n=None).collect()
    assert [(x["customer"], x["frequency"], x["monetary"], x["recency_days"]) for x in r] == [
        (1, 2, 12.0, 30), (2, 1, 12.0, 59), (3, 1, 12.0, 30)]  # monetary ties -> customer order
    top = aggs.top_n(sales, "book", "unit", 2, "units").collect()
    assert [(x["book"], x["units"]) for x in top] == [("x", 3.0), ("z", 3.0)]
    moy = {x["month"]: x["total_sell"] for x in aggs.month_of_year(sales).collect()}
    assert len(moy) == 12 and moy[3] == 19.0 and moy[12] == 0.0
    piv = aggs.year_month_pivot(sales).first()
    assert (piv["year"], piv["m1"], piv["m2"], piv["m3"], piv["m4"]) == (2024, 5.0, 12.0, 19.0, 0.0)


def test_cleaning_helpers(spark):
    from shelfwise.operators import clean

    df = spark.createDataFrame([(1.0, 3.0, 2.0, " Male "), (5.0, 1.0, 1.0, "x"), (2.0, 2.0, None, None)],
                               "sell double, cost double, unit double, gender string")
    flagged, thr = clean.high_value_flag(clean.with_profit(df), "profit", 0.5)
    assert thr == 0.0 and [r["high_value_customer"] for r in flagged.collect()] == [0, 1, 1]  # >= threshold
    clipped = [r[0] for r in df.select(clean.clipped_profit_expr(df)).collect()]
    assert clipped == [0.0, 4.0, 0.0]  # sell/cost stand in for the prices; unit NULL counts 1
    assert clean.total_amount(df.withColumn("total_amount", F.lit(1.0)), "unit", "sell").first()["total_amount"] == 1.0
    assert clean.drop_cols(df, ["cost", "nope"]).columns == ["sell", "unit", "gender"]
    ns = {r["column_name"]: (r["null_count"], r["row_count"]) for r in clean.null_summary(df).collect()}
    assert ns == {"sell": (0, 3), "cost": (0, 3), "unit": (1, 3), "gender": (1, 3)}
    nn = clean.non_numeric(df.withColumn("t", F.lit("7")), ["gender", "t"]).collect()
    assert sorted((r["column_name"], r["value"]) for r in nn) == [("gender", " Male "), ("gender", "x")]
    cats = [r[0] for r in df.select(clean.standardize_category("gender", ["male", "female"])).collect()]
    assert cats == ["male", "unknown", "unknown"]


def test_knn_regression_matches_brute_force(spark):
    import random as _r

    from shelfwise.operators.neighbors import knn

    rnd = _r.Random(4)
    train = [(i, [rnd.random(), rnd.random()], float(rnd.randrange(100))) for i in range(200)]
    query = [(1000 + i, [rnd.random(), rnd.random()], 0.0) for i in range(30)]
    tdf = spark.createDataFrame(train, "id long, embedding array<double>, label double").repartition(4)
    qdf = spark.createDataFrame(query, "id long, embedding array<double>, label double")
    got = {r["id"]: r["prediction"] for r in knn(tdf, qdf, k=3, id_col="id", task="regress", pivots=6, block_rows=7).collect()}
    for qid, qv, _ in query:
        d = sorted((((qv[0] - v[0]) ** 2 + (qv[1] - v[1]) ** 2), i, y) for i, v, y in train)[:3]
        assert got[qid] == pytest.approx(sum(y for _, _, y in d) / 3)
