"""What the sheets leave on disk."""

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import io


def test_sheets_are_kept_compressed(spark, tmp_path):
    df = spark.range(500).select("id", F.lit('He said "hi"\nvol. 2').alias("book"))
    plain, packed = str(tmp_path / "plain.csv"), str(tmp_path / "packed.csv")
    io.write_csv(df.coalesce(1), plain)
    io.write_csv(df.coalesce(1), packed, compression="gzip")
    size = [sum(p.stat().st_size for p in (tmp_path / d).glob("part-*")) for d in ("plain.csv", "packed.csv")]
    assert size[1] * 3 < size[0]
    back = io.read_all(spark, f"{packed}/*.csv.gz", fmt="csv", multiline=True)
    assert back.count() == 500 and back.select("book").distinct().collect() == df.select("book").distinct().collect()


def test_shuffles_of_a_write_are_dropped(spark, tmp_path):
    from shelfwise.session import shuffles_dropped

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before


def test_sales_sheets_leave_little_on_disk(spark, monkeypatch):
    """The sheets were plain text, larger than all input tables."""
    import glob
    import os

    import __spark_entry__ as E
    from shelfwise.plans import queries
    from tests.conftest import SF_SMALL

    made, own = [], queries._shared_folder
    monkeypatch.setattr(queries, "_shared_folder", lambda *a: made.append(own(*a)) or made[-1])
    rows = E.queries()["s1_sales_sheets"](spark, SF_SMALL)
    sheets = sum(os.path.getsize(f) for f in glob.glob(f"{made[0].removeprefix('file:')}/*/part-*"))
    tables = sum(os.path.getsize(f"{SF_SMALL}/{t}.parquet") for t in ("lineitem", "orders", "part", "customer"))
    assert 0 < sheets < tables
    assert rows.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
