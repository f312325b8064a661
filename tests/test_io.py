"""Sources and sinks on a fresh temporary folder."""

import os

from pyspark.sql import functions as F

from shelfwise.sources import (
    LINE_KEY,
    clean_columns,
    keep,
    read_all,
    read_table,
    read_yearly,
    sales_view,
    write_csv,
    write_merged,
)
from tests.conftest import SF_SMALL


def test_yearly_files_roundtrip(spark, tmpdir_fresh):
    s = sales_view(spark, SF_SMALL).select(*LINE_KEY, "book", "sell", "year")
    years = sorted(r["year"] for r in s.select("year").distinct().collect())[:3]
    paths = []
    for y in years:
        p = os.path.join(tmpdir_fresh, f"Sell - {y + 28}.csv")  # file names carry 20xx years
        write_csv(s.where(F.col("year") == y).drop("year"), p)
        paths.append(p)
    back = read_yearly(spark, paths)
    got = {r["year"]: r["n"] for r in back.groupBy("year").agg(F.count("*").alias("n")).collect()}
    want = {r["year"] + 28: r["n"] for r in s.where(F.col("year").isin(years)).groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_read_all_and_merged(spark, tmpdir_fresh):
    s = sales_view(spark, SF_SMALL).select(*LINE_KEY, "sell", "year")
    out = os.path.join(tmpdir_fresh, "merged.parquet")
    write_merged(s, out)
    assert any(d.startswith("year=") for d in os.listdir(out))
    back = read_table(spark, out)
    assert back.count() == s.count()
    every = read_all(spark, out + "/*/*.parquet", fmt="parquet")
    assert every.where(F.col("source_file").isNull()).count() == 0


def test_clean_columns_and_keep(spark):
    df = spark.createDataFrame([(1, 2)], "` Order Date ` int, `Repeated Customer's?` int")
    assert clean_columns(df).columns == ["Order Date", "Repeated Customer's?"]
    assert clean_columns(df, underscore=True).columns == ["Order_Date", "Repeated_Customers?"]
    kept = keep(df)
    assert kept.is_cached
    kept.unpersist()


def test_sheets_with_their_own_headers_year_quotes_and_order(spark, tmpdir_fresh):
    from shelfwise.plans.dashboard import Dashboard

    a = os.path.join(tmpdir_fresh, "Sell - 2023.csv")
    b = os.path.join(tmpdir_fresh, "Sell - 2024.csv")
    with open(a, "w", encoding="utf-8") as f:
        f.write(" Order Date ,Customer Phone,Name of Books,Category Of Books,Gender,Delivery Method,Unit,Sell,Cost,Repeated Customer?,Year\n")
        f.write('01/15/2024,017,"he said ""hi"", ok",Novel,Male,Home,2,"1,200",800,yes,2022\n')
        f.write('15-Jan-2024,017,"two\nlines",Novel,Male,Home,1,1.5k,12d,no,\n')
        f.write('01/15/2024,017,"he said ""hi"", ok",Novel,Male,Home,9,900,800,yes,2022\n')
    with open(b, "w", encoding="utf-8") as f:
        f.write("Sell,Name of Books,City,Order Date,Gender,Delivery Method,Category Of Books,Unit,Customer Phone\n")
        f.write("500,plain,Dhaka,\"Jan 5, 2024\",Female,Shop,Poems,1,018\n")
    raw = read_yearly(spark, [a, b], multiline=True)
    assert [r["year"] for r in raw.orderBy("`Name of Books`", "Unit").collect()] == [2022, 2022, 2024, 2023]
    dash = Dashboard.from_files(spark, [a, b], multiline=True)
    rows = {r["book"]: r for r in dash.prepared.collect()}
    assert set(rows) == {'he said "hi", ok', "two\nlines", "plain"} and all(r["year"] == 2024 for r in rows.values())
    assert rows["two\nlines"]["cost"] == 12.0 and rows["plain"]["City"] == "Dhaka"
    kpi = dash.overview()["kpis"].first()
    assert kpi["total_orders"] == 3 and kpi["total_sell"] == 1200 * 2 + 1500 + 500  # the first of two equal orders counts
    both = read_all(spark, os.path.join(tmpdir_fresh, "*.csv"), multiline=True)
    assert both.where("City = 'Dhaka'").first()["Name of Books"] == "plain" and both.count() == 4
    out = os.path.join(tmpdir_fresh, "out.csv")
    write_csv(raw.select("Name of Books"), out)
    import csv
    import glob

    text = [r for p in sorted(glob.glob(out + "/part-*")) for r in csv.reader(open(p, encoding="utf-8"))]
    assert ['he said "hi", ok'] in text and ["two\nlines"] in text


def test_numbers_and_dates_as_sheets_spell_them(spark):
    from shelfwise.functions.parse import to_number, to_ts

    nums = [("12d", None), ("12f", None), (" 12.5 ", 12.5), ("1e3", 1000.0), (".5", 0.5), ("-3.", -3.0), ("1,2", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in nums], "t string")
    assert [r["v"] for r in df.select(to_number("t").alias("v")).collect()] == [v for _, v in nums]
    dates = ["01/15/2024", "15-Jan-2024", "Jan 15, 2024", "2024/01/15", "15/01/2024", "2024-01-15", "15 Jan 2024", "2024-01-15 00:00:00", "15-Jan-24"]
    df = spark.createDataFrame([(t,) for t in [*dates, "bad", "", None, "13/13/2024"]], "t string")
    got = [str(r["v"]) for r in df.select(to_ts("t").alias("v")).collect()]
    assert got == ["2024-01-15 00:00:00"] * len(dates) + ["None"] * 4
