"""Dates by column, missing numbers, medians of whole numbers, tokens of any length."""

import datetime as dt

import pytest

from shelfwise.functions.parse import to_number, to_ts
from shelfwise.functions.text import piece_tokens, word_pieces, word_tokens
from shelfwise.operators import clean


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, d {kind}")


def dates(df):
    return [r["d"] for r in clean.with_dates(df, ["d"]).orderBy("i").collect()]


def test_a_column_has_one_order(spark):
    day = dt.datetime
    got = dates(column(spark, ["03/04/2024", "15/04/2024", " 16-04-2024 ", "04/15/2024", "1/2/2024 13:05"]))
    assert got == [day(2024, 4, 3), day(2024, 4, 15), day(2024, 4, 16), None, day(2024, 2, 1, 13, 5)]
    got = dates(column(spark, ["03/04/2024", "04/15/2024", "12/31/2024 8:00:01", "15/04/2024"]))
    assert got == [day(2024, 3, 4), day(2024, 4, 15), day(2024, 12, 31, 8, 0, 1), None]
    # no value that tells: month first, unless said
    assert dates(column(spark, ["03/04/2024"])) == [day(2024, 3, 4)]
    assert clean.with_dates(column(spark, ["03/04/2024"]), ["d"], day_first=True).first()["d"] == day(2024, 4, 3)


def test_serial_days_and_junk(spark):
    day = dt.datetime
    cells = ["45292", "45292.75", "2024", "99999", "1234", "nan", "", None, "13/13/2024", "01/02/3024", "0001-01-01", "2024-02-30", "x45292"]
    got = dates(column(spark, cells))
    assert got[:2] == [day(2024, 1, 1), day(2024, 1, 1, 18)] and got[2:] == [None] * 11
    assert dates(column(spark, [45292.0, None, 1e300], "double")) == [day(2024, 1, 1), None, None]
    assert dates(column(spark, [45292, 20240101], "int")) == [day(2024, 1, 1), None]
    iso = ["2024-01-15T10:11:12", "2024-01-15 10:11:12.5", "2024-01-15 10:11", "2024/1/5", "15.01.2024", "Jan 5, 2024", "5 January 2024"]
    assert dates(column(spark, iso)) == [day(2024, 1, 15, 10, 11, 12), day(2024, 1, 15, 10, 11, 12, 500000), day(2024, 1, 15, 10, 11),
                                         day(2024, 1, 5), day(2024, 1, 15), day(2024, 1, 5), day(2024, 1, 5)]


def test_order_counts_in_one_job(spark):
    df = spark.createDataFrame([("01/31/2024", "31/01/2024", None)] * 3, "a string, `b.c` string, n string")
    spark.sparkContext.setJobGroup("orders", "orders")
    assert clean.date_orders(df, ["a", "b.c", "n"]) == {"a": False, "b.c": True, "n": False}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("orders")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # one aggregate (its exchange may count as a job)
    assert clean.date_orders(df, []) == {}


def test_prepare_sales_bounds_the_calendar(spark):
    from shelfwise.operators.series import resample

    df = spark.createDataFrame([("45292", 1.0), ("02/01/2024", 2.0), ("13/01/2024", 3.0), ("12345678", 4.0)], "order_date string, sell double")
    p = clean.prepare_sales(df)
    assert resample(p.where("order_date is not null"), "sell", "day", name="sell").count() == 13
    one = to_ts("order_date", day_first=False)
    assert [r[0] for r in df.select(one).collect()][1:3] == [dt.datetime(2024, 2, 1), None]


def test_nan_is_missing(spark):
    df = column(spark, ["nan", "NaN", "-nan", "inf", "1", None, "x"])
    assert [r[0] for r in df.orderBy("i").select(to_number("d", 7.0)).collect()] == [7.0, 7.0, 7.0, float("inf"), 1.0, 7.0, 7.0]
    floats = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "d double")
    assert [r[0] for r in floats.select(to_number("d", 0.0)).collect()] == [0.0, 2.0, 0.0]
    sale = spark.createDataFrame([("nan", "1", "2"), ("5", "nan", "nan"), ("5", "1", "3")], "sell_price string, buying_price string, unit string")
    assert [r[0] for r in sale.select(clean.clipped_profit_expr(sale)).collect()] == [0.0, 5.0, 12.0]


def test_median_of_whole_numbers_may_be_a_half(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 20), (4, 30), (None, 40)], "a int, b long")
    out, med = clean.fill_median(df, ["a", "b"])
    assert med == {"a": 2.5, "b": 25.0}
    assert sorted(r["a"] for r in out.collect()) == [1, 2, 2.5, 3, 4] and 25.0 in [r["b"] for r in out.collect()]


@pytest.mark.parametrize("text", ["y" * 70_000, "a " + "b" * 200_000 + " c", "x" * 65_536 + " z", " " * 70_000 + "q", ("w" * 100 + ", ") * 2_000, ""])
def test_tokens_of_any_length(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    whole = df.select(word_tokens("t").alias("w")).first()["w"]
    for chars in (7, 65_536):
        pieces = df.selectExpr("t").select(word_pieces("t", chars).alias("p")).selectExpr("posexplode(p) as (i, p)")
        got = [w for r in pieces.select("i", piece_tokens("p").alias("w")).orderBy("i").collect() for w in r["w"]]
        assert got == whole
