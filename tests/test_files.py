"""Headers of many files in one job, one year replaced, a bucketed side without an exchange."""

import glob
import os
import uuid

from pyspark.sql import functions as F

from shelfwise.sources import io


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_two_hundred_files_in_as_many_jobs_as_eighty(spark, tmpdir_fresh):
    def sheets(folder, n):
        for i in range(n):
            rows = "".join(f"{i}-{j},{j}\n" for j in range(30))
            _write(f"{tmpdir_fresh}/{folder}/Sell - {i:03}.csv", ("name,unit\n" if i % 2 else "unit,name\n") + rows)
        return f"{tmpdir_fresh}/{folder}/*.csv"

    few, many = sheets("few", 80), sheets("many", 200)
    a, jobs_few = _jobs(spark, lambda: io.read_all(spark, few))
    b, jobs_many = _jobs(spark, lambda: io.read_all(spark, many))
    assert jobs_few == jobs_many
    assert b.count() == 6000 and b.select("source_file").distinct().count() == 200
    assert b.where("name = '7-3'").count() == 1 and b.where("unit = '8-3'").count() == 1


def test_header_records(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/h"
    _write(f"{root}/a b.csv", 'x,"two\nlines",z\n1,2,3\n')
    _write(f"{root}/c.csv", "x,z\r\n" + "5,6\r\n" * 50_000)
    _write(f"{root}/empty.csv", "")
    _write(f"{root}/only.csv", "x,z")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = {os.path.basename(p): h for p, h in io.header_lines(spark, f"{root}/*.csv").items()}
    assert found == {"a b.csv": 'x,"two\nlines",z', "c.csv": "x,z", "only.csv": "x,z"}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    both = io.read_all(spark, f"{root}/*.csv", multiline=True)
    assert both.count() == 50_001 and both.where("x = '1'").first()["two\nlines"] == "2"


def test_no_files_with_rows(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/e/empty.csv", "")
    assert io.read_all(spark, f"{tmpdir_fresh}/e/*.csv").columns == ["source_file"]


def test_one_year_is_replaced(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/merged"
    df = spark.createDataFrame([(1, 2023), (2, 2023), (3, 2024), (4, None)], "v int, year int")
    io.write_merged(df, path)
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/year=*/*.parquet")}
    before = files()
    io.replace_parts(spark.createDataFrame([(30, 2024), (31, 2024)], "v int, year int"), path)
    after = files()
    kept = {p for p in before if "year=2024" not in p}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert not [p for p in before if "year=2024" in p and p in after]
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 4, 30, 31]


def test_bucketed_side_of_a_join_has_no_exchange(spark, tmpdir_fresh):
    name = f"books_{uuid.uuid4().hex}"
    books = spark.range(5000).select(F.concat(F.lit("b"), "id").alias("book"), "id")
    try:
        stored = io.write_bucketed(books, name, f"{tmpdir_fresh}/{name}", ["book"], 8)
        sales = spark.range(20000).select(F.concat(F.lit("b"), F.col("id") % 5000).alias("book"), F.col("id").alias("line"))
        joined = sales.hint("merge").join(stored, "book")
        assert joined.count() == 20000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(book") and "Bucketed: true" in plan
        scan = plan[plan.index("Bucketed: true") - 400 : plan.index("Bucketed: true")]
        assert "Exchange" not in scan
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
